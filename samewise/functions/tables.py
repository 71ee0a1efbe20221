"""Word lists, expansions and transliterations that results depend on."""

#: Legal forms and other words that say nothing in a business name, romanised Indic spellings included.
LEGAL = (
    "inc incorporated corp corporation co company ltd limited llc lc llp lp plc pllc pc ltda holdings holding group intl international "
    "pvt private pl opc praivet praivate pra li limitet limitad limeted prailet elelpi prai "
    "sa sas sasu sarl sarlu eurl snc sci scop sca scs gie ei eirl etablissements ets "
    "gmbh mbh ag kg ohg ug bv nv as ab oy aps srl spa sl slu sau lda "
    "the and of"
).split()

ADDRESS_STOPWORDS = "the of and at in on a".split()

#: Address abbreviations; they come before states, and states before stop words.
ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "avn": "avenue", "blvd": "boulevard", "bvd": "boulevard",
    "ln": "lane", "dr": "drive", "ct": "court", "plz": "plaza", "sq": "square", "ter": "terrace", "trl": "trail", "pkwy": "parkway",
    "pky": "parkway", "hwy": "highway", "expy": "expressway", "cir": "circle", "cres": "crescent", "gdns": "gardens", "gdn": "garden", "mt": "mount",
    "ft": "fort", "jct": "junction", "xing": "crossing", "apt": "apartment", "apts": "apartment", "ste": "suite", "fl": "floor",
    "flr": "floor", "flt": "flat", "bldg": "building", "blg": "building", "rm": "room", "dept": "department", "num": "number",
    "bsmt": "basement", "unit": "unit", "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "nr": "near", "opp": "opposite", "bh": "behind",
    "sec": "sector", "ph": "phase", "colny": "colony", "cly": "colony", "nag": "nagar", "ngr": "nagar", "mkt": "market", "extn": "extension",
    "ext": "extension", "soc": "society", "chs": "society", "mg": "mahatma gandhi", "vill": "village", "po": "post office",
    "distt": "district", "dist": "district", "tq": "taluka", "bd": "boulevard", "bld": "boulevard", "r": "rue", "imp": "impasse",
    "all": "allee", "chem": "chemin", "ch": "chemin", "rte": "route", "pl": "place", "res": "residence", "bat": "batiment",
    "esc": "escalier", "etg": "etage", "zi": "zone industrielle", "za": "zone artisanale", "bp": "boite postale",
}

STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "ia": "iowa", "ks": "kansas",
    "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah",
    "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}

#: Words of an address that are too general for keys.
GENERIC_ADDRESS = (
    "street road avenue lane drive court place square boulevard circle terrace trail parkway highway floor suite apartment unit building room "
    "number near opposite behind block phase sector nagar colony north south east west new old post office rue"
).split()

TOP_LEVEL_DOMAINS = "com net org co in fr biz info io".split()

#: Digraphs of the consonant skeleton, in the order they are replaced, and the letters folded after them.
DIGRAPHS = (("chh", "S"), ("sch", "S"), ("sh", "S"), ("ch", "S"), ("kh", "K"), ("gh", "K"), ("th", "T"), ("dh", "T"), ("ph", "P"), ("bh", "P"), ("ng", "N"), ("ny", "N"))
FOLDS = {"K": "kgqcx", "P": "pbfvw", "T": "td", "S": "sjz", "L": "lr", "M": "mn"}
SILENT = "yhaeiou"

#: Starts of the nine Indic blocks, each of 128 code points in parallel order, and romanisations by offset.
INDIC_BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l",
    0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x58: "k", 0x59: "kh", 0x5A: "g", 0x5B: "j", 0x5C: "r", 0x5D: "r", 0x5E: "ph", 0x5F: "y", 0x79: "r", 0x7A: "y", 0x7B: "r", 0x7C: "r",
}
VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li"}
VOWEL_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "ri", 0x63: "li"}
NASALS = {0x00: "n", 0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA, NUKTA, AVAGRAHA, DIGIT_ZERO = 0x4D, 0x3C, 0x3D, 0x66
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0xFEFF)

#: Most postings of a key, by tag, beyond which it is a stop key.
CAPS = {"F": 4000, "T": 2000, "B": 2000, "G": 250, "P": 400, "N": 400, "A": 400}
