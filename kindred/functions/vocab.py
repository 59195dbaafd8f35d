"""Word lists of the normal forms."""

# Fixed values.
LEGAL_SUFFIXES = (
    "& and ag assn associates business bv co company consultants consulting corp corporation enterprise enterprises gmbh group holding holdings inc incorporated "
    "industries international intl limited llc llp lp ltd nv partner partners plc private pte public pvt sa sarl services solutions sys systems tech technologies trust"
).split()

ADDRESS_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "way": "way", "ct": "court", "pl": "place",
    "sq": "square", "ter": "terrace", "trl": "trail", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "bldg": "building", "ste": "suite", "fl": "floor", "ft": "fort",
    "mt": "mount", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "no": "number", "nr": "near",
}

STOPWORDS = (
    "the a an of in on at to for and or is are was were be been being have has had do does did will would could should may might shall can need dare ought used "
    "it its this that these those i you he she we they me him her us them my your his our their new old near opp opposite behind beside next above below between "
    "among through across along around against during before after since until while about into within without"
).split()

SOUNDEX_CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}
