"""Word lists of the normalisation, as text, and Column look-ups over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: they decide what two records have in common -------------
COUNTRIES = "us=us, usa=us, united states=us, india=india, in=india, france=france, fr=france"

NAME_WORDS = """
pvt=private, pte=private, ltd=limited, ltda=limited, corp=corporation, inc=incorporated, incorp=incorporated, co=company,
intl=international, bros=brothers, svcs=services, svc=service, mfg=manufacturing, assoc=associates, assocs=associates,
ctr=center, centre=center, mgmt=management, natl=national, univ=university, hosp=hospital, grp=group, cie=compagnie, ets=etablissements
"""
LEGAL_ANYWHERE = "private limited llp llc incorporated corporation pllc plc lp sarl sas sasu eurl sci snc selarl gmbh"
LEGAL_AT_END = "company pc pa sa public"
DROPPED_AT_END = "and of the"
DROPPED_AT_START = "the"
LEGAL_FOR_SKELETON = "private limited pvt ltd llp llc incorporated inc corporation corp company co public sarl sas sasu eurl gmbh plc pllc"
LETTERS = "ø=o Ø=o ł=l Ł=l ß=ss æ=ae Æ=ae œ=oe Œ=oe đ=d ı=i"
DIGITS_AS_LETTERS = "0=o 1=l 3=e 4=a 5=s 7=t 8=b"
DOMAINS = r"co\.in com net org biz info in fr us io"

ADDRESS_WORDS = {
    "": "apartment=apt, building=bldg, floor=fl, flr=fl, number=no, num=no",
    "us": """street=st, road=rd, drive=dr, avenue=ave, av=ave, boulevard=blvd, lane=ln, terrace=ter, place=pl, court=ct,
highway=hwy, parkway=pkwy, circle=cir, square=sq, trail=trl, suite=ste, north=n, south=s, east=e, west=w, northeast=ne,
northwest=nw, southeast=se, southwest=sw, mount=mt, fort=ft, saint=st, expressway=expy, freeway=fwy, center=ctr, centre=ctr""",
    "india": """road=rd, street=st, sector=sec, sect=sec, nr=near, opposite=opp, extension=extn, ext=extn, phase=ph, block=blk,
lane=ln, avenue=ave, industrial=indl, cross=crs""",
    "france": """r=rue, bd=bd, bld=bd, blvd=bd, boulevard=bd, av=av, ave=av, avenue=av, pl=pl, place=pl, imp=imp, impasse=imp,
ch=chemin, che=chemin, chem=chemin, rte=rte, route=rte, all=allee, fbg=fbg, faubourg=fbg, qu=quai, sq=sq, square=sq, crs=cours,
st=saint, ste=sainte, pass=passage, res=residence, q=quai, appt=apt, n=no""",
}

STATES = {
    "us": """alabama=al, alaska=ak, arizona=az, arkansas=ar, california=ca, colorado=co, connecticut=ct, delaware=de,
district of columbia=dc, florida=fl, georgia=ga, hawaii=hi, idaho=id, illinois=il, indiana=in, iowa=ia, kansas=ks, kentucky=ky,
louisiana=la, maine=me, maryland=md, massachusetts=ma, michigan=mi, minnesota=mn, mississippi=ms, missouri=mo, montana=mt,
nebraska=ne, nevada=nv, new hampshire=nh, new jersey=nj, new mexico=nm, new york=ny, north carolina=nc, north dakota=nd, ohio=oh,
oklahoma=ok, oregon=or, pennsylvania=pa, rhode island=ri, south carolina=sc, south dakota=sd, tennessee=tn, texas=tx, utah=ut,
vermont=vt, virginia=va, washington=wa, west virginia=wv, wisconsin=wi, wyoming=wy, puerto rico=pr""",
    "india": """andhra pradesh=ap, arunachal pradesh=ar, assam=as, bihar=br, chhattisgarh=cg, chattisgarh=cg, ct=cg, goa=ga,
gujarat=gj, haryana=hr, himachal pradesh=hp, jharkhand=jh, karnataka=ka, kerala=kl, madhya pradesh=mp, maharashtra=mh, manipur=mn,
meghalaya=ml, mizoram=mz, nagaland=nl, odisha=od, orissa=od, or=od, punjab=pb, rajasthan=rj, sikkim=sk, tamil nadu=tn, tamilnadu=tn,
telangana=tg, ts=tg, tripura=tr, uttar pradesh=up, uttarakhand=uk, uttaranchal=uk, ut=uk, west bengal=wb, delhi=dl, nct of delhi=dl,
jammu and kashmir=jk, jammu kashmir=jk, ladakh=la, puducherry=py, pondicherry=py, chandigarh=ch, andaman and nicobar islands=an,
lakshadweep=ld, उत्तर प्रदेश=up, दिल्ली=dl, महाराष्ट्र=mh, मध्य प्रदेश=mp, राजस्थान=rj, बिहार=br, गुजरात=gj, हरियाणा=hr, पंजाब=pb,
कर्नाटक=ka, तमिलनाडु=tn, तमिल नाडु=tn, केरल=kl, पश्चिम बंगाल=wb, तेलंगाना=tg, आंध्र प्रदेश=ap, ओडिशा=od, झारखंड=jh, झारखण्ड=jh,
छत्तीसगढ़=cg, उत्तराखंड=uk, उत्तराखण्ड=uk, असम=as, गोवा=ga, हिमाचल प्रदेश=hp, चंडीगढ़=ch, தமிழ்நாடு=tn""",
    "france": """ile de france=idf, hauts de france=hdf, nouvelle aquitaine=naq, pays de la loire=pdl, bretagne=bre, normandie=nor,
grand est=ges, bourgogne franche comte=bfc, centre val de loire=cvl, auvergne rhone alpes=ara, provence alpes cote d azur=pac, paca=pac,
occitanie=occ, corse=cor, nord=hdf, pas de calais=hdf, somme=hdf, aisne=hdf, oise=hdf, gironde=naq, landes=naq, dordogne=naq,
lot et garonne=naq, pyrenees atlantiques=naq, loire atlantique=pdl, vendee=pdl, maine et loire=pdl, sarthe=pdl, mayenne=pdl""",
}
BLOCKS_MERGED = {"india": "tg=ap, la=jk"}
POSTCODES = {"us": r"\d{5}", "france": r"\d{5}", "india": r"[1-8]\d{5}"}
PLACEHOLDERS = "nan none null n/a na - -- . unknown"

#: Latin consonants: pairs first, in this order, then single letters; others are dropped.
PAIRS = "mp=np mb=np ch=c sh=s th=t ph=f kh=k gh=k bh=p dh=t jh=c ck=k"
CONSONANTS = "b=p c=k d=t f=f g=k h=h j=c k=k l=l m=m n=n p=p q=k r=r s=s t=t v=v w=v x=ks z=c"
#: The consonant of a letter by its place within an Indic script's block of 128 code points.
INDIC = {
    0x01: "n", 0x02: "n", 0x15: "k", 0x16: "k", 0x17: "k", 0x18: "k", 0x19: "n", 0x1A: "c", 0x1B: "c", 0x1C: "c", 0x1D: "c", 0x1E: "n", 0x1F: "t", 0x20: "t", 0x21: "t",
    0x22: "t", 0x23: "n", 0x24: "t", 0x25: "t", 0x26: "t", 0x27: "t", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "f", 0x2C: "p", 0x2D: "p", 0x2E: "m", 0x30: "r", 0x31: "r",
    0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "s", 0x37: "s", 0x38: "s", 0x39: "h", 0x58: "k", 0x59: "k", 0x5A: "k", 0x5B: "c", 0x5C: "t", 0x5D: "t", 0x5E: "f",
}
# ---- end of fixed values ----------------------------------------------------

#: Code points of the Indic blocks, which share their layout.
INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)


def pairs(text: str, between: str = ",") -> dict[str, str]:
    return dict(tuple(x.strip() for x in item.rsplit("=", 1)) for item in text.split(between) if item.strip())


def with_values(table: dict[str, str]) -> dict[str, str]:
    """Values stand for themselves too."""
    return table | {v: v for v in table.values() if v not in table}


def cleaned_keys(table: dict[str, str]) -> dict[str, str]:
    """Keys as base_clean and the removal of marks leave them."""
    from kinmatch.functions.text import fold_text

    return {" ".join(fold_text(k).split()): v for k, v in table.items()}


def indic_table() -> tuple[str, str]:
    """Letters and their consonants, for translate()."""
    letters = {chr(block + place): consonant for block in INDIC_BLOCKS for place, consonant in INDIC.items()}
    return "".join(letters), "".join(letters.values())


def lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value, null if it has none."""
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def by_country(tables: dict[str, dict[str, str]], country: Column, key: Column) -> Column:
    """The key's value in its country's table, null if there is none."""
    out = F.lit(None).cast("string")
    for name, values in tables.items():
        out = F.when(country == name, lookup(values, key)).otherwise(out)
    return out


def word_array(text: str) -> Column:
    return F.lit(text.split())
