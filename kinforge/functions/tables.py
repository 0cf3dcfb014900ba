"""Fixed lookup values of name and address normalisation, and tables built from rules."""

from __future__ import annotations

import unicodedata

# Legal forms by family. Keys are the family codes 1 to 11.
LEGAL_FAMILIES = {
    1: "inc incorporated",
    2: "corp corporation",
    3: "llc",
    4: "ltd limited",
    5: "pvt private",
    6: "plc",
    7: "llp lp partnership",
    8: "sarl eurl",
    9: "sa sas sasu",
    10: "gmbh ag kg",
    11: "co company",
}
#: Legal forms without a family.
LEGAL_OTHER = "pc pllc opc sci snc scop gie sel selarl bv nv ulc"
# Spelled-out legal phrases and their short form.
LEGAL_PHRASES = {
    "limited liability company": "llc", "limited liability partnership": "llp", "limited partnership": "lp", "private limited": "pvt ltd", "public limited company": "plc",
    "professional corporation": "pc", "societe a responsabilite limitee": "sarl", "societe anonyme": "sa", "societe par actions simplifiee": "sas", "one person company": "opc",
}
#: Legal forms that are also words; the first word of a name stays if another legal form follows.
AMBIGUOUS = "pc sel sa co sci ag lp"
#: Words that say what a business is and are never legal forms.
FILLERS = "group holdings holding enterprises enterprise services service solutions international global the of and"
STOPWORDS = "the of and for in at de la le les du des et l d a an"
# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
DOMAINS = "com net org in fr co io biz info us eu shop"
# Administrative areas.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl",
    "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
INDIAN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh",
    "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "punjab": "pb", "rajasthan": "rj",
    "sikkim": "sk", "tamil nadu": "tn", "telangana": "ap", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "new delhi": "dl", "chandigarh": "ch", "puducherry": "py",
}
FRENCH_REGIONS = [
    "auvergne rhone alpes", "bourgogne franche comte", "bretagne", "centre val de loire", "corse", "grand est", "hauts de france", "ile de france", "normandie", "nouvelle aquitaine", "occitanie",
    "pays de la loire", "provence alpes cote d azur", "guadeloupe", "martinique", "guyane", "la reunion", "mayotte",
]
#: Departments of a region (only those whose name no city shares).
FRENCH_DEPARTMENTS = {"nord": "hauts de france", "pas de calais": "hauts de france", "somme": "hauts de france", "oise": "hauts de france", "aisne": "hauts de france", "rhone": "auvergne rhone alpes", "isere": "auvergne rhone alpes", "gironde": "nouvelle aquitaine", "bouches du rhone": "provence alpes cote d azur", "var": "provence alpes cote d azur", "haute garonne": "occitanie", "herault": "occitanie", "bas rhin": "grand est", "haut rhin": "grand est", "finistere": "bretagne", "morbihan": "bretagne", "loire atlantique": "pays de la loire", "calvados": "normandie"}
ABBREVIATIONS = {
    "street": "st", "saint": "st", "avenue": "ave", "av": "ave", "road": "rd", "boulevard": "blvd", "bd": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy",
    "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "fl", "north": "n", "south": "s", "east": "e", "west": "w", "r": "rue", "nagar": "ngr", "sector": "sec", "marg": "mg", "opposite": "opp", "near": "nr",
    "industrial": "ind", "estate": "est", "center": "ctr", "centre": "ctr", "allee": "all", "chemin": "che", "impasse": "imp", "quai": "qu", "route": "rte", "faubourg": "fbg",
}
ADDRESS_STOPS = "st ave rd blvd dr ln ct pl sq hwy pkwy ste apt bldg fl rue de la le les du des the and of n s e w all che imp qu rte ctr nr opp"
CITY_ALIASES = {"bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "gurgaon": "gurugram", "poona": "pune", "nyc": "new york city"}
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ODD_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def ordinals() -> dict[str, str]:
    """Ordinal words from 1 to 99 and their number: by rule from the cardinal words."""
    def of(word: str) -> str:
        return ODD_ORDINALS.get(word) or (word[:-1] + "ieth" if word.endswith("y") else word + "th")

    out = {of(w): str(i) for i, w in enumerate(ONES, 1)}
    for t, ten in enumerate(TENS, 2):
        out[of(ten)] = str(10 * t)
        out |= {f"{ten} {of(w)}": str(10 * t + i) for i, w in enumerate(ONES[:9], 1)}
    return out


def accents() -> tuple[str, str]:
    """Accented Latin letters and what is left of them, by rule: the first letter of their decomposition."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        d = unicodedata.normalize("NFKD", c)
        if d[0] != c and d[0].isascii():
            pairs.append((c, d[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def families() -> dict[str, int]:
    return {w: k for k, words in LEGAL_FAMILIES.items() for w in words.split()} | {w: 12 for w in LEGAL_OTHER.split()}
