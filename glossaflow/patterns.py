"""Text patterns and literal values shared by the whole library."""

# --- Fixed values: results depend on these being exactly as they are. --------

# Characters that count as white space (the Unicode set a plain str.split uses).
WS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set as inclusive code point ranges, for the Arrow kernel.
WS_RANGES = (
    (0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
)
# Line separators.
LINE = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# One ideograph, or one run of ASCII letters and digits.
TOKEN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]|[A-Za-z0-9]+"
# Those ideographs as inclusive code point ranges.
IDEOGRAPH_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF))
# Word runs, and the runs that count as capitalised words.
WORD = r"[\p{L}\p{N}_]+"
CAPITALISED = r"^[A-Z][A-Za-z]+\z"
# Numbers; a trailing dot belongs to the number.
NUMBER = r"\p{Nd}+\.?\p{Nd}*"
# Decoding leftovers removed from the end of a prediction.
TAIL_TOKENS = ("⽗", "父", "<|im_end|>", "<|endoftext|>")
# Labels of the two-line answer format.
TRANSCRIPTION_LABEL = "Transcription: "
TRANSLATION_LABEL = "Translation: "
TRANSLATION_KEY = "translation:"
# Media placeholder in a user turn, and the media file name rule.
MEDIA_MARK = "<audio>"
MEDIA_SUFFIX = ".wav"
MEDIA_ORDINAL = r"(\d+)\.wav\z"
# Row outcomes.
STATUS_OK = "ok"
STATUS_OOM = "OOM"
STATUS_ERROR = "ERR:"
EMPTY_ERROR = "empty src/ref"
# Printed form of a corpus BLEU score.
BLEU_FORMAT = (
    "BLEU = %s %s/%s/%s/%s "
    "(BP = %s ratio = %s hyp_len = %d ref_len = %d)"
)
# n-gram orders: BLEU uses 1-4, chrF 1-6 with recall weight beta.
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2.0

# --- Derived, Java regular expressions. --------------------------------------

# Possessive runs never back up, and the look-behind starts a match only at the
# head of a white space run: both keep matching linear on long blank stretches.
WS_RUN = WS + "++"
LEADING_WS = r"\A" + WS_RUN
TRAILING_WS = rf"(?<!{WS}){WS_RUN}\z"
TAIL = (
    rf"(?<!{WS})(?:{WS_RUN}|"
    + "|".join(t.replace("|", r"\|") for t in TAIL_TOKENS)
    + r")++\z"
)
# Characters a removable tail can end with.
TAIL_END = WS[:-1] + "".join(t[-1] for t in TAIL_TOKENS[:3]) + "]"
