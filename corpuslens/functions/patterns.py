r"""Regular expressions for tokens and entities.

The patterns are written in the subset that java.util.regex and RE2 share
(``\x{..}`` escapes, scoped flags), apart from lookarounds and possessive loops.  Java
matches loops over groups of varying length by recursion, which overflows the stack on
long junk; such loops are possessive where nothing follows them, and otherwise written
as one-character steps with a lookahead.
"""

from __future__ import annotations

# Character classes (contents only).
SPACE_CHARS = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
APOSTROPHE_CHARS = r"'\x{201B}\x{2BC}\x{2018}\x{2019}\x{2032}\x{91}\x{92}`"
HYPHEN_CHARS = r"\-_\x{58A}\x{2010}-\x{2015}"
BRACKET_START_CHARS = r"(\[{\x{2329}\x{2768}\x{2E28}\x{3008}\x{300A}\x{FE59}\x{FE5B}\x{FF08}\x{FF3B}\x{FF5B}"
BRACKET_END_CHARS = r")\]}\x{232A}\x{2769}\x{2E29}\x{3009}\x{300B}\x{FE5A}\x{FE5C}\x{FF09}\x{FF3D}\x{FF5D}"
QUOTE_START_CHARS = r"\x{2018}\x{201C}\x{91}\x{93}\x{2039}\x{AB}\x{201A}\x{201E}"
QUOTE_END_CHARS = r"\x{2019}\x{201D}\x{92}\x{94}\x{203A}\x{BB}\x{201B}\x{201F}"
QUOTE_CHARS = APOSTROPHE_CHARS + '"' + QUOTE_START_CHARS + QUOTE_END_CHARS
SYMBOL_CHARS = r"\\/@#_*&=+%<>~^|"
PUNCT_INSIDE_CHARS = r",;:\x{204F}\x{FE50}\x{FE54}\x{FE55}\x{FF1B}\x{FF0C}\x{FF1A}"
PUNCT_END_CHARS = r".?!\x{A1}\x{BF}\x{2047}\x{2048}\x{2049}\x{FE52}\x{FE56}\x{FE57}\x{FF01}\x{FF0E}\x{FF1F}"
# Latin letters without multiplication sign, thorn, sharp s, division sign and slashed o; soft hyphen.
LETTER_CHARS = (
    r"A-Za-z\x{C0}-\x{D6}\x{D9}-\x{DD}\x{E0}-\x{F6}\x{F9}-\x{FD}\x{FF}"
    r"\x{130}\x{131}\x{178}\x{17F}\x{212A}\x{212B}\x{AD}"
)
CURRENCY_CHARS = (
    r"$\x{A2}\x{A3}\x{A4}\x{A5}\x{58F}\x{60B}\x{9F2}\x{9F3}\x{9FB}\x{AF1}\x{BF9}\x{E3F}\x{17DB}\x{20A0}-\x{20BD}"
    r"\x{A838}\x{FDFC}\x{FE69}\x{FF04}\x{FFE0}\x{FFE1}\x{FFE5}\x{FFE6}"
)
WORD_CHARS = r"\p{L}\p{N}_"  # what \w means for Unicode text
EYE_CHARS = (
    r"\^ˆᵔ＾￣▔─⌒◡~.・･•ﾟ°゜⊙oO□\-_✯★◕☆'✧˘❛T´≧><｀`≦<μ♡❤/\\˙⇀↼x=+*￢¬→←∂ゝᗒ"
)
ARM_CHARS = r"<>～\\＼⌒ヽﾉノ／/╰╯o٩۶｡ﾟdwシΣ∑Σヾ凸"
MOUTH_CHARS = r".\-―ー－_ωεз³3З∀‿◡ᴗ︶⌣▽人ヮ\^ｏ〇ロ︹ヘ︿‸ᗣ" + SPACE_CHARS

SPACE = f"[{SPACE_CHARS}]"
SPACES = f"[{SPACE_CHARS}]+"
APOSTROPHE = f"[{APOSTROPHE_CHARS}]"
HYPHEN = f"[{HYPHEN_CHARS}]"
BRACKET_START = f"[{BRACKET_START_CHARS}]"
BRACKET_END = f"[{BRACKET_END_CHARS}]"
BRACKET = f"[{BRACKET_START_CHARS}{BRACKET_END_CHARS}]"
QUOTE_START = f"[{QUOTE_START_CHARS}]{{1,2}}"
QUOTE_END = f"[{QUOTE_END_CHARS}]{{1,2}}"
QUOTE = f"[{QUOTE_CHARS}]"
SYMBOL = f"[{SYMBOL_CHARS}]"
DOTS = rf"(?:\.\.\.|[\x{{85}}\x{{2025}}\x{{2026}}]|\.{SPACE}\.{SPACE}\.)"
PUNCT_INSIDE = f"[{PUNCT_INSIDE_CHARS}]"
PUNCT_END = rf"(?:\?!|[{PUNCT_END_CHARS}])"
# Classes that give one-character tokens are tried together; '_' is left to the hyphens.
_SINGLE_CHARS = PUNCT_INSIDE_CHARS + BRACKET_START_CHARS + BRACKET_END_CHARS + SYMBOL_CHARS.replace("_", "")
PUNCT = f"(?:[{_SINGLE_CHARS}]|{QUOTE}+|{DOTS}|{PUNCT_END}|{HYPHEN}+)"

# Numbers, dates, units.
D = r"\p{Nd}"
UNSIGNED = rf"{D}++(?:[.,\x{{AD}}]{D}++)*+"
SIGNED = rf"[\-+]{UNSIGNED}"
NUMBER = rf"[\-+]?{UNSIGNED}"
SUBSUP = (
    r"[\x{207A}\x{207B}\x{208A}\x{208B}]?(?:[\x{2070}\x{B9}\x{B2}\x{B3}\x{2074}-\x{2079}]+|[\x{2080}-\x{2089}]+)"
)
FRACTION = rf"(?:{D}{{1,4}}[\- \x{{A0}}])?{D}{{1,4}}(?:\\?/|\x{{2044}}){D}{{1,4}}"
VULGAR_FRACTION = r"[\x{BC}\x{BD}\x{BE}\x{2153}-\x{215E}]"
CURRENCY = f"[{CURRENCY_CHARS}]"
PERCENT = f"{NUMBER}%"
RATIO = f"(?:[1-9]{D}+|{D})(?::{D}+)"
DATE_DMY = r"[0-9]{1,2}[\-/][0-9]{1,2}[\-/][0-9]{2,4}"
DATE_YMD = r"[0-9]{2,4}[\-/][0-9]{1,2}[\-/][0-9]{1,2}"
DATE = f"(?:{DATE_DMY}|{DATE_YMD})"
TIME = f"{D}+(?::{D}+){{1,2}}"
ISO8601 = f"{DATE_YMD}T{TIME}Z"
DEGREES = r"\x{B0}[CF]"
VERSION = rf"[vV]?{D}(?:\.{D})*(?:\.{D}|\.x)(?=\P{{Nd}}|\z)"
PHONE = rf"\+?(?:\({D}{{2,3}}\)[{SPACE_CHARS}\-])?{D}{{2,3}}(?:[{SPACE_CHARS}\-]{D}{{2,4}})++"
NUMERIC = "(?:" + "|".join(
    [ISO8601, DATE, PHONE, FRACTION, TIME, RATIO, VERSION, NUMBER, SUBSUP, VULGAR_FRACTION]
) + ")"

# Words and abbreviations.
LETTER = f"[{LETTER_CHARS}]"
SOFT_HYPHEN = r"\x{AD}"
WORD = rf"{LETTER}[{LETTER_CHARS}{D}]*"
CENSORED = f"{LETTER}{{1,2}}{SYMBOL}+{LETTER}{{1,3}}"
ABBREVIATION_SIMPLE = (
    r"(?:[A-Za-z]\.){2,}|[A-Za-z]{2,3}\.(?:[A-Za-z]\.?)|[A-Za-z]{1,2}[.&][A-Za-z]|[A-Za-z]\."
)
ABBREVIATION_LIST = [
    "(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)",
    "(?:Mon|Tue|Tues|Wed|Thu|Thurs|Fri|Sat|Sun)",
    "(?:Inc|Cos?|Corp|Pp?t[ye]s?|Ltd|Plc|Rt|Bancorp|Bhd|Assn|Univ|Coll|Intl|Sys|Invt|Elec|Natl|M[ft]g|Dept)",
    "(?:tel|est|ext|sq|fl|oz)",
    r"(?:Jr|Sr|Bros|Esq|(?:Ed|Ph)\.D|Ph)",
    "(?:Mr|Mrs|Ms|Miss|Drs?|Profs?|Reps?|Attys?|Lt|Col|Gen|Messrs|Govs?|Adm|Rev|Maj|Sgt|Cpl|Pvt|Capt|Ste?|Col)",
    "(?:Pres|Lieut|Hon|Brig|Co?mdr|Pfc|Spc|Supts?|Det|Mt|Ft|Adj|Adv|Asst|Assoc|Ens|Insp|Mlle|Mme|Msgr|Sfc)",
    "(?:etc|al|seq|acc|cf)",
    "(?:adj|adv|Anniv|Attrib|Cal|Calc|Civ|Cl|dict)",
    "(?:ca|Figs?|prop|art|bldg|prop|pp|op|Conf|def|doc|ed|abbr|abbrv|abbrev)",
    "(?:Blvd|Rd|Ave|Apt|Ctr|Cts?|Hls?|Lk|Ln|Prt|Trl|Addr|Brit)",
]
# Every listed form starts with two to seven letters and a dot; testing that first is cheap.
ABBREVIATION_START = r"(?=[A-Za-z]{2,7}\.)"
ABBREVIATION = rf"(?:{ABBREVIATION_SIMPLE}|{ABBREVIATION_START}(?i:{'|'.join(ABBREVIATION_LIST)})\.)"
PROGRAMMING_LANGUAGE = r"[CF][\-+#]{1,2}"

# Contractions.
CONTRACTION = f"(?:n{APOSTROPHE}t|{APOSTROPHE}(?:[msd]|re|ve|ll))"
SPLIT_SUFFIX = f"(?:n{APOSTROPHE}t|{APOSTROPHE}(?:[sd]|re|ve|ll))"
KEPT_WHOLE = [
    f"{APOSTROPHE}n{APOSTROPHE}?",
    f"{APOSTROPHE}k",
    f"{APOSTROPHE}em",
    f"{APOSTROPHE}im",
    f"{APOSTROPHE}er",
    f"{APOSTROPHE}till?",
    f"{APOSTROPHE}sup",
    f"{APOSTROPHE}cause",
    f"{APOSTROPHE}cuz",
    f"{APOSTROPHE}[2-9]0s",
    f"[ldj]{APOSTROPHE}",
    f"dunkin{APOSTROPHE}",
    f"somethin{APOSTROPHE}",
    f"ol{APOSTROPHE}",
    f"o{APOSTROPHE}clock",
    rf"cont{APOSTROPHE}d\.?",
    f"nor{APOSTROPHE}easter",
    f"c{APOSTROPHE}mon",
    f"e{APOSTROPHE}er",
    f"s{APOSTROPHE}mores",
    f"ev{APOSTROPHE}ry",
    f"li{APOSTROPHE}l",
    f"cap{APOSTROPHE}n",
]
CONTRACTION_I_AM = f"[Ii](?={APOSTROPHE}[Mm])"
CONTRACTION_YOU = f"[Yy]{APOSTROPHE}(?={LETTER}{{3}})"
CONTRACTION_STEM = f"(?i:[a-z]+(?={SPLIT_SUFFIX}))"
CONTRACTION_IT = f"(?i:{APOSTROPHE}t(?=is|was))"
CONTRACTION_LISTED = f"(?i:{'|'.join(KEPT_WHOLE)})"
CONTRACTION_OTHER = f"{WORD}{APOSTROPHE}{WORD}"
SUBJECT_CONTRACTION = f"(?i:[a-z]+{CONTRACTION}++)"

# Web addresses, handles, emoticons, arrows.
_URL_CHAR = rf"[^{SPACE_CHARS}()<>{{}}\[\]]"
_URL_PARENS = rf"\([^{SPACE_CHARS}]+?\)"
_URL_LAST = rf"""[^{SPACE_CHARS}`!()\[\]{{}};:'".,<>?\x{{AB}}\x{{BB}}\x{{201C}}\x{{201D}}\x{{2018}}\x{{2019}}]"""
URL_BODY_LOOPS = (
    rf"(?:{_URL_CHAR}|{_URL_PARENS}){_URL_CHAR}*(?:{_URL_PARENS}{_URL_CHAR}*)*(?:{_URL_PARENS}|{_URL_LAST})"
)
# The same in possessive steps, which take no stack: a part in parentheses is as short as the
# rest of the address allows, and only the last part may end where no address can go on.
_URL_PARENS_ON = rf"{_URL_PARENS}(?={_URL_CHAR}*(?:{_URL_PARENS}|{_URL_LAST}))"
URL_BODY_STEPS = (
    rf"(?:{_URL_CHAR}|{_URL_PARENS_ON})"
    rf"(?:(?:{_URL_CHAR}*(?:{_URL_PARENS_ON}|{_URL_LAST}))++(?:{_URL_CHAR}*{_URL_PARENS})?|{_URL_CHAR}*{_URL_PARENS})"
)
URL_SCHEME = rf"(?:(?:https?:|[A-z]{{2,}}:)(?:/{{1,3}}|[a-z0-9%])|[a-z0-9.\-]+\.[a-z]{{2,13}}/){URL_BODY_STEPS}"
# Labels between dots, one of them with hyphens, then a top-level domain.
URL_DOMAIN_LOOPS = r"[a-z0-9]+(?:\.[a-z0-9]+)*(?:(?:-[a-z0-9]+)+(?:\.[a-z0-9]+)*)?\.[a-z]{2,13}"
_LABELS = r"(?:(?!\.\.)[a-z0-9.])*"
_HYPHENATED = r"(?:(?!--)[a-z0-9\-])*(?<=[a-z0-9])"
URL_DOMAIN_STEPS = (
    rf"[a-z0-9]{_LABELS}(?:(?<=[a-z0-9])-[a-z0-9]{_HYPHENATED}(?:\.[a-z0-9]{_LABELS})?)?\.[a-z]{{2,13}}"
)
URL = rf"(?i:{URL_SCHEME}|{URL_DOMAIN_STEPS}(?::{D}{{2,5}})?/?(?!@))"
EMAIL_HOST_LOOPS = r"[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*"
EMAIL_HOST_STEPS = r"[A-Za-z0-9](?:(?!\.\.)[A-Za-z0-9.\-])*"
EMAIL = rf"[a-zA-Z0-9.\-_']+@{EMAIL_HOST_STEPS}\.[{WORD_CHARS}]{{2,}}"
HANDLE = r"[@\x{FF20}][a-zA-Z_][a-zA-Z_0-9]*"
HASHTAG = rf"[#\x{{FF03}}][{WORD_CHARS}]+[{WORD_CHARS}'\-]*[{WORD_CHARS}]+"
_FACE = (
    rf"[{ARM_CHARS}]{{0,2}}{SPACE}?\(.{{0,3}}[{EYE_CHARS}].{{0,2}}[{MOUTH_CHARS}].{{0,2}}[{EYE_CHARS}].{{0,3}}\)"
    rf"{SPACE}?[{ARM_CHARS}]{{0,2}}"
)
_FACE_BARE = r"[\^x=~<>]\.\[\^x=~<>\]|[\-\^x=~<>']_[\-\^x=~<>']"
_SMILEY = (
    r"[:=;](?:|-o?|[^a-zA-Z0-9 ]|[Oo]|\*|')"
    rf"(?:[D)\]]+|[(\[{{]+|[pPd3]+(?=[^{WORD_CHARS}]|\z)|(?:[oO]+|[/\\]+|[vV]+|[Ss]+|[|]+|@))"
)
HEARTS = "(?:<+/?3+)++"
EMOTICON = f"(?:{_FACE}|{_FACE_BARE}|{_SMILEY}|{HEARTS})"
ARROW = rf"(?:<*[{HYPHEN_CHARS}=]*>+|<+[{HYPHEN_CHARS}=]*>*|[\x{{2190}}-\x{{21FF}}]+)"
COPYRIGHT = r"[\x{A9}\x{AE}\x{2184}\x{2122}]"

# Token rules in the order in which they are tried.
TOKEN_RULES: list[tuple[str, str]] = [
    ("SPACES", SPACES),
    ("URL", URL),
    ("EMAIL", EMAIL),
    ("ABBREVIATION", ABBREVIATION),
    ("NUMERIC", NUMERIC),
    ("CONTRACTION", CONTRACTION),
    ("CONTRACTION_W1", CONTRACTION_I_AM),
    ("CONTRACTION_W2", CONTRACTION_YOU),
    ("CONTRACTION_W3", CONTRACTION_STEM),
    ("CONTRACTION_W4", CONTRACTION_IT),
    ("CONTRACTION_WE", CONTRACTION_LISTED),
    ("CONTRACTION_WO", CONTRACTION_OTHER),
    ("CENSORED_WORD", CENSORED),
    ("SOFT_HYPHEN", SOFT_HYPHEN),
    ("PROGRAMMING_LANGUAGES", PROGRAMMING_LANGUAGE),
    ("WORD", WORD),
    ("HASHTAG", HASHTAG),
    ("USER_HANDLE", HANDLE),
    ("EMOTICON", EMOTICON),
    ("DEGREES", DEGREES),
    ("PUNCT", PUNCT),
]

# Entity kinds for extraction from running text.
ENTITY_KINDS: dict[str, str] = {
    "whitespace": SPACES,
    "apostrophe": APOSTROPHE,
    "hyphen": HYPHEN,
    "bracket_start": BRACKET_START,
    "bracket_end": BRACKET_END,
    "bracket": BRACKET,
    "quote_start": QUOTE_START,
    "quote_end": QUOTE_END,
    "quote": QUOTE,
    "symbol": SYMBOL,
    "dots": DOTS,
    "punct_inside": PUNCT_INSIDE,
    "punct_end": PUNCT_END,
    "punct": PUNCT,
    "number": NUMBER,
    "signed_number": SIGNED,
    "subsup_number": SUBSUP,
    "fraction": FRACTION,
    "vulgar_fraction": VULGAR_FRACTION,
    "currency": CURRENCY,
    "percent": PERCENT,
    "ratio": RATIO,
    "date": DATE,
    "time": TIME,
    "iso8601": ISO8601,
    "degrees": DEGREES,
    "version": VERSION,
    "phone": PHONE,
    "numeric": NUMERIC,
    "letter": LETTER,
    "word": WORD,
    "censored_word": CENSORED,
    "abbreviation": ABBREVIATION,
    "programming_language": PROGRAMMING_LANGUAGE,
    "contraction": CONTRACTION,
    "subject_contraction": SUBJECT_CONTRACTION,
    "url": URL,
    "email": EMAIL,
    "handle": HANDLE,
    "hashtag": HASHTAG,
    "emoticon": EMOTICON,
    "hearts": HEARTS,
    "arrow": ARROW,
    "copyright": COPYRIGHT,
}
# Characters of which every match of a kind has one; none is an ASCII letter or a blank.
_SUBSUP_CHARS = r"\x{B9}\x{B2}\x{B3}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
_VULGAR_CHARS = r"\x{BC}\x{BD}\x{BE}\x{2153}-\x{215E}"
ENTITY_NEEDS: dict[str, str] = {
    "apostrophe": APOSTROPHE_CHARS,
    "hyphen": HYPHEN_CHARS,
    "bracket_start": BRACKET_START_CHARS,
    "bracket_end": BRACKET_END_CHARS,
    "bracket": BRACKET_START_CHARS + BRACKET_END_CHARS,
    "quote_start": QUOTE_START_CHARS,
    "quote_end": QUOTE_END_CHARS,
    "quote": QUOTE_CHARS,
    "symbol": SYMBOL_CHARS,
    "number": D,
    "signed_number": r"\-+",
    "subsup_number": _SUBSUP_CHARS,
    "fraction": r"/\x{2044}",
    "vulgar_fraction": _VULGAR_CHARS,
    "currency": CURRENCY_CHARS,
    "percent": "%",
    "ratio": ":",
    "date": r"\-/",
    "time": ":",
    "iso8601": ":",
    "degrees": r"\x{B0}",
    "version": D,
    "phone": D,
    "numeric": D + _SUBSUP_CHARS + _VULGAR_CHARS,
    "censored_word": SYMBOL_CHARS,
    "programming_language": r"\-+#",
    "contraction": APOSTROPHE_CHARS,
    "subject_contraction": APOSTROPHE_CHARS,
    "url": r":/.",
    "email": "@",
    "handle": r"@\x{FF20}",
    "hashtag": r"#\x{FF03}",
    "emoticon": r"(\[_:=;<",
    "hearts": "<",
    "arrow": r"<>\x{2190}-\x{21FF}",
    "copyright": r"\x{A9}\x{AE}\x{2184}\x{2122}",
}
COMMON = r"[A-Za-z ]++"  # left out before these characters are looked for
URL_NEEDS = r"[:/]|\.[A-Za-z]{2}"  # a scheme, a path or a domain
LOOKAHEAD_KINDS = ("version", "numeric", "url", "emoticon")


def portable(pattern: str) -> str:
    """The same language without lookbehinds and possessive loops, for other engines."""
    for steps, loops in (
        (URL_BODY_STEPS, URL_BODY_LOOPS),
        (URL_DOMAIN_STEPS, URL_DOMAIN_LOOPS),
        (EMAIL_HOST_STEPS, EMAIL_HOST_LOOPS),
        (ABBREVIATION_START, ""),
        ("}++", "}+"),
        (")++", ")+"),
        (")*+", ")*"),
    ):
        pattern = pattern.replace(steps, loops)
    return pattern
