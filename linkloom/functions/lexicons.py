"""Fixed values that normalised forms depend on."""

# fixed values: word lists and tables
LEGAL_SUFFIXES = [
    "ab", "ag", "as", "assoc", "association", "bv", "co", "company", "corp", "corporation", "eirl", "enterprise", "enterprises", "eurl", "firm", "gmbh",
    "group", "holding", "holdings", "inc", "incorporated", "kg", "kgaa", "limited", "llc", "llp", "lp", "ltd", "nv", "ou", "oy", "partnership", "plc",
    "private", "pt", "pte", "pvt", "sa", "sas", "sasu", "sc", "sci", "sel", "selarl", "snc", "society", "spa", "srl", "te", "trust", "venture",
    "ventures",
]
NAME_STOP = [
    "a", "an", "and", "at", "for", "in", "of", "on", "the",
]
ADDRESS_STOP = [
    "and", "of", "the",
]
#: pkwy2 is a dead key, kept because the table has it.
STREETS = dict(
    rd="road", st="street", ave="avenue", av="avenue", blvd="boulevard", dr="drive", ln="lane", ct="court", cir="circle", hwy="highway", pkwy="parkway", pl="place", sq="square",
    ter="terrace", trl="trail", xing="crossing", pkwy2="parkway", byp="bypass", expy="expressway", fwy="freeway", rte="route", mt="mount", ft="fort", hills="hills",
)
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
INDIA_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka",
    "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu",
    "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu", "kashmir", "puducherry",
]
INDIA_ALIASES = {"orissa": "odisha", "pondicherry": "puducherry"}
MOJIBAKE = (("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("Â—", "-"), ("Â–", "-"), ("Ã¢", "-"))
SCRIPTS = (
    ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("myanmar", 0x1000, 0x109F), ("khmer", 0x1780, 0x17FF), ("japanese", 0x3040, 0x30FF), ("chinese", 0x4E00, 0x9FFF), ("korean", 0xAC00, 0xD7AF),
)
#: First code points of the Indic blocks, which share one layout.
INDIC_BLOCKS = {"devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}
#: ITRANS values by place in a block: marks, vowels, consonants, vowel signs.
INDIC_LETTERS = {
    0x01: "N", 0x02: "M", 0x03: "H", 0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "~N", 0x1A: "ch", 0x1B: "Ch", 0x1C: "j", 0x1D: "jh", 0x1E: "~n", 0x1F: "T", 0x20: "Th", 0x21: "D", 0x22: "Dh", 0x23: "N",
    0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "L", 0x35: "v",
    0x36: "sh", 0x37: "Sh", 0x38: "s", 0x39: "h", 0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au",
}
LETTER_FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "ð": "d"}
FAMILIES = ("sig", "pfx", "tok", "phon", "ini", "hn", "atok", "combo", "hnstate", "atok2")


def state_lookup() -> dict[str, str]:
    """Names, names without spaces and codes to a canonical state."""
    out = {**US_STATES, **{s: s for s in INDIA_STATES}, **INDIA_ALIASES}
    return out | {k.replace(" ", ""): v for k, v in US_STATES.items()} | {v: v for v in US_STATES.values()}
