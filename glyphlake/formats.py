"""Fixed values of the carrier format, and its thresholds. They must stay as they are for carriers to be exchangeable."""

# Carriers
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CHUNK = b"siMl"
WEBP_CHUNK = b"siML"
JPEG_IDENT = b"JP02"
BOX_LABEL = b"siml\x00"
BOX_UUID = bytes.fromhex("de6062e19e7b494e94b3db6fcc257fdc")
PAYLOAD_CAP = 4 * 1024 * 1024
SEGMENT_CAP = 65_535
TOO_LONG = "SIML_E_004"
VERSION_FIELD, VERSION = "siml", "0.3"
ID_PREFIX = "siml-"

# Watermark
SYNC = 0xD4B3
WIDTH = 1024
STEP, MARGIN, SMOOTH_STEP = 26.0, 18.0, 13.0
TEXTURE_EMBED, TEXTURE_DECODE = 8.0, 3.0
MIN_REPEATS, MIN_VOTES = 8, 4
PARITY, CAPACITY, PASSES = 4, 16, 3
COEFFICIENT = (2, 1)

# Fingerprint
GRID, LOW = 32, 16
MATCH, STALE, REGION, GAP, TIGHT = 24, 10, 40, 4, 6
PAD_X, PAD_Y = 0.02, 0.04

# Text fields
TYPES = ["phone", "url", "email", "address", "text"]
ACTIONABLE = ["url", "phone", "email", "address"]
INTENTS = ["actionable", "readonly", "auto"]
WEIGHTS = ["regular", "medium", "bold"]
ALIGNS = ["left", "center", "right"]
SCHEMES = ["https:", "http:", "tel:", "mailto:", "geo:"]
PHONE = r"^[+()\d][\d\s\-().]{6,}$"
URL = r"(?i)^(https?://|www\.)\S+$"
EMAIL = r"^\S+@\S+\.\S+$"
CONFUSIONS = {
    "O": "0", "o": "0", "D": "0", "Q": "0",
    "l": "1", "I": "1", "i": "1", "|": "1", "!": "1",
    "Z": "2", "z": "2", "E": "3", "A": "4",
    "S": "5", "s": "5", "G": "6", "b": "6",
    "T": "7", "?": "7", "B": "8", "g": "9", "q": "9",
}
CANDIDATES = 4096
POINT = 1.333  # pixels a point

# Stash
STASH_SECONDS, STASH_CAP = 300, 25 * 1024 * 1024
