"""Fixed values of the record-linkage domain: word lists, tables and patterns."""

# Legal forms as (pattern, label), tried in this order.
LEGAL_SUFFIXES = [
    (r"\bprivate\s+limited\b", "pvt_ltd"),
    (r"\bpvt\s+ltd\b", "pvt_ltd"),
    (r"\bpvt\s+limited\b", "pvt_ltd"),
    (r"\bprivate\s+ltd\b", "pvt_ltd"),
    (r"\blimited\s+liability\s+company\b", "llc"),
    (r"\blimited\s+liability\s+partnership\b", "llp"),
    (r"\bpublic\s+limited\s+company\b", "plc"),
    (r"\bsociete\s+a\s+responsabilite\s+limitee\b", "sarl"),
    (r"\bsociete\s+par\s+actions\s+simplifiee\s+unipersonnelle\b", "sasu"),
    (r"\bsociete\s+par\s+actions\s+simplifiee\b", "sas"),
    (r"\bsociete\s+anonyme\b", "sa"),
    (r"\bentreprise\s+unipersonnelle\s+a\s+responsabilite\s+limitee\b", "eurl"),
    (r"\bsociete\s+civile\s+immobiliere\b", "sci"),
    (r"\bsociete\s+en\s+nom\s+collectif\b", "snc"),
    (r"\bgroupement\s+d\s+interet\s+economique\b", "gie"),
    (r"\bincorporated\b", "inc"),
    (r"\bcorporation\b", "corp"),
    (r"\bcompany\b", "co"),
    (r"\blimited\b", "ltd"),
    (r"\binc\b", "inc"),
    (r"\bcorp\b", "corp"),
    (r"\bllc\b", "llc"),
    (r"\bllp\b", "llp"),
    (r"\bplc\b", "plc"),
    (r"\bpllc\b", "pllc"),
    (r"\bltd\b", "ltd"),
    (r"\bpvt\b", "pvt"),
    (r"\bco\b", "co"),
    (r"\bsarl\b", "sarl"),
    (r"\bsas\b", "sas"),
    (r"\bsasu\b", "sasu"),
    (r"\bsa\b", "sa"),
    (r"\beurl\b", "eurl"),
    (r"\bsci\b", "sci"),
    (r"\bsnc\b", "snc"),
    (r"\bgie\b", "gie"),
    (r"\bste\b", "ste"),
    (r"प्राइवेट\s+लिमिटेड", "pvt_ltd"),
    (r"प्राइवेट", "pvt"),
    (r"लिमिटेड", "ltd"),
    (r"एलएलपी", "llp"),
]

# Address abbreviations, expanded in this order.
ADDRESS_WORDS = [
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("dr", "drive"), ("ln", "lane"), ("blvd", "boulevard"),
    ("ct", "court"), ("pkwy", "parkway"), ("hwy", "highway"), ("apt", "apartment"), ("ste", "suite"), ("fl", "floor"),
    ("dept", "department"), ("bldg", "building"), (r"po\s+box", "pobox"), ("av", "avenue"), ("bd", "boulevard"),
    ("pl", "place"), ("all", "allee"), ("rte", "route"),
]

# Words that mark an address as given by a landmark.
LANDMARK = r"(?i)\b(?:near|opp|opposite|behind|beside|adjacent|next\s+to|in\s+front\s+of|near\s+by|close\s+to)\b"
PIN6 = r"\b([1-9][0-9]{5})\b"
ZIP5 = r"\b([0-9]{5})(?:-[0-9]{4})?\b"
STREET_NUMBER = r"\b(\d+(?:[a-zA-Z]|/\d+)?)\b"

# Postal pattern by country; other countries try six digits, then five.
POSTAL = {"INDIA": (PIN6,), "US": (ZIP5,), "FRANCE": (ZIP5,)}

# Words that are no part of a business's own name.
LEGAL_STOPWORDS = """
sas sarl sasu sa sci eurl ei snc scs gie france club association comite comité ecole école ets etablissements
établissements societe société groupement centre center services solutions holdings group groupe cie freres frères
associates associés bureau agence llc inc corp ltd pvt limited co company plc corporation incorporated enterprises
industries trading management consulting ventures india international national trust hospital clinic
""".split()
# Further words of the audit's list.
AUDIT_STOPWORDS = [*LEGAL_STOPWORDS, *"foyer jeunes sportive danse musique culture loisirs amicale amis fondation federation fédération".split()]

# Kinds of streets; the short forms are not in the audit's list.
AUDIT_STREET_TYPES = """
street avenue road boulevard drive lane court place highway way circle rue cours chemin route impasse quai chaussee
allee parvis square cross main marg
""".split()
STREET_TYPES = [*AUDIT_STREET_TYPES, *"st ave rd blvd dr ln ct pl hwy sq".split()]

# Cities and regions, which tell no street apart.
CITIES = """
france nord hauts rhone alpes provence cote dazur ile paris haute bas lyon marseille toulouse bordeaux nice nantes
strasbourg montpellier rennes lille reims saint etienne toulon grenoble dijon angers nimes villeurbanne
usa california texas florida york illinois pennsylvania ohio georgia carolina michigan jersey virginia washington
arizona massachusetts tennessee indiana missouri maryland wisconsin colorado minnesota alabama louisiana kentucky
chicago houston phoenix philadelphia antonio diego dallas austin jacksonville columbus charlotte indianapolis seattle
denver boston elpaso nashville detroit oklahoma portland lasvegas memphis louisville baltimore milwaukee albuquerque
india delhi mumbai bangalore bengaluru hyderabad chennai kolkata pune ahmedabad jaipur surat lucknow kanpur nagpur
indore thane bhopal visakhapatnam patna vadodara ghaziabad ludhiana agra nashik faridabad meerut rajkot varanasi
srinagar aurangabad dhanbad amritsar navi allahabad howrah gwalior jabalpur coimbatore vijayawada jodhpur madurai
raipur kota guwahati chandigarh solapur hubli dharwad mysore tiruchirappalli bareilly aligarh tiruppur gurgaon noida
tamil nadu maharashtra karnataka pradesh uttar gujarat rajasthan bengal kerala telangana andhra bihar punjab haryana
""".split()

# Words that no blocking key is made of.
GENERIC_STOPS = """
the and of for in to a an de la du company services corporation limited private enterprises solutions inc llc ltd corp pvt
""".split()
ADDRESS_STOPS = """
road street avenue drive lane boulevard floor unit apartment suite near opp building block sector plot door no pobox
st ave rd blvd
""".split()

# Devanagari letters in Latin script.
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh",
    "स": "s", "ह": "h", "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri",
    "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "्": "", "ं": "n", "ँ": "n", "ः": "h",
}

# The audit's token table; a key listed twice keeps its later value.
AUDIT_TOKENS = {
    "ave": "avenue", "st": "street", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "pl": "place",
    "hwy": "highway", "ste": "suite", "apt": "apartment", "no": "", "pmb": "", "box": "", "po": "",
    "r": "rue", "av": "avenue", "bd": "boulevard", "all": "allee", "allee": "allee", "allée": "allee", "cours": "cours",
    "chemin": "chemin", "route": "route", "imp": "impasse", "impasse": "impasse", "quai": "quai", "chaussee": "chaussee",
    "chaussée": "chaussee", "bis": "", "ter": "",
    "ny": "new york", "tx": "texas", "ca": "california", "il": "illinois", "oh": "ohio", "pa": "pennsylvania",
    "fl": "florida", "ga": "georgia", "nc": "north carolina", "va": "virginia", "wa": "washington", "az": "arizona",
    "tn": "tennessee", "in": "indiana", "mo": "missouri", "md": "maryland", "wi": "wisconsin", "co": "colorado",
    "mn": "minnesota", "sc": "south carolina", "al": "alabama", "la": "louisiana", "ky": "kentucky", "or": "oregon",
    "ok": "oklahoma", "ct": "connecticut", "ut": "utah", "ia": "iowa", "nv": "nevada", "ar": "arkansas",
    "ms": "mississippi", "ks": "kansas", "nm": "new mexico", "ne": "nebraska", "wv": "west virginia", "id": "idaho",
    "hi": "hawaii", "nh": "new hampshire", "me": "maine", "ri": "rhode island", "mt": "montana", "de": "delaware",
    "sd": "south dakota", "nd": "north dakota", "ak": "alaska", "vt": "vermont", "wy": "wyoming",
}

# Names that stand for no name.
PLACEHOLDERS = ["", "null", "n/a", "none", "-", ".", "unknown", "na", "<null>", "no name", "nan"]
