"""Name normalisation (N1-N10): script-aware folding to upper-case ASCII and CJK tokens.

ASCII text takes a native path; other text an Arrow UDF, because Spark has no Unicode
decomposition.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and what they stand for.
LOOKALIKES = str.maketrans("АВЕКМНОРСТУХІЈЅавекмнорстухіјѕ", "ABEKMHOPCTYXIJSabekmhopctyxijs")
CYRILLIC = dict(
    zip(
        "А Б В Г Д Е Ё Ж З И Й К Л М Н О П Р С Т У Ф Х Ц Ч Ш Щ Ъ Ы Ь Э Ю Я Ґ Є І Ї Ў Ђ Ј Љ Њ Ћ Џ Ѓ Ќ Ѕ".split(),
        "A B V G D E E ZH Z I Y K L M N O P R S T U F KH TS CH SH SHCH - Y - E YU YA G YE I YI W DJ J LJ NJ C DZ G K DZ".split(),
        strict=True,
    )
)
GREEK = dict(zip("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΪΫ", "A V G D E Z I TH I K L M N X O P R S T Y F CH PS O I Y".split(), strict=True))
ARABIC = dict(
    zip(
        "ا أ إ آ ٱ ب ت ث ج ح خ د ذ ر ز س ش ص ض ط ظ ع غ ف ق ك ل م ن ه ة و ؤ ي ى ئ ء پ چ ژ گ ک ی".split(),
        "A A I A A B T TH J H KH D DH R Z S SH S D T Z - GH F Q K L M N H H W W Y A Y - P CH ZH G K Y".split(),
        strict=True,
    )
)
HEBREW = dict(zip("א ב ג ד ה ו ז ח ט י כ ך ל מ ם נ ן ס ע פ ף צ ץ ק ר ש ת".split(), "- V G D H V Z CH T Y K K L M M N N S - P F TS TS K R SH T".split(), strict=True))
TABLES = {k: str.maketrans({a: b.replace("-", "") for a, b in t.items()}) for k, t in (("cyrillic", CYRILLIC), ("greek", GREEK), ("arabic", ARABIC), ("hebrew", HEBREW))}
# Ranges of the scripts.
RANGES = {
    "cyrillic": "Ѐ-ӿ",
    "greek": "Ͱ-Ͽ",
    "arabic": "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿",
    "hebrew": "֐-׿יִ-ﭏ",
    "cjk": "㐀-䶿一-鿿豈-﫿぀-ゟ゠-ヿ가-힯",
}
IN_SCRIPT = {k: re.compile(f"[{v}]") for k, v in RANGES.items()}
HARAKAT, NIQQUD = re.compile("[ً-ٰٟۖ-ۭ]"), re.compile("[֑-ׇ]")
LATIN = re.compile("[A-Za-z]")
MARKS = re.compile("[̀-ͯ]")
DROP = re.compile(f"[^A-Z0-9{RANGES['cjk']}]+")
SEAM = re.compile(f"(?<=[{RANGES['cjk']}])(?=[A-Z0-9])|(?<=[A-Z0-9])(?=[{RANGES['cjk']}])")
# Given names and particles that alone identify nobody.
WEAK_NAMES = (
    "ALI MOHAMMED MOHAMMAD MUHAMMAD AHMED AHMAD ABDUL ABDULLAH HASSAN HUSSEIN HUSAIN IBRAHIM KHAN SAID SAYED AL BIN IBN BINT ABU UM EL THE AND OF"
).split()


@dataclass(frozen=True)
class Lexicon:
    """Words to strip, canonical words, titles (longest first) and confusable character pairs."""

    strip: frozenset = frozenset()
    canon: dict = field(default_factory=dict)
    titles: tuple = ()
    confusable: frozenset = frozenset()


EMPTY = Lexicon()


def strip_marks(s: str) -> str:
    return unicodedata.normalize("NFC", MARKS.sub("", unicodedata.normalize("NFD", s)))


def fold_word(word: str) -> str:
    """One white-space-free word to Latin; a word that mixes Latin and Cyrillic is read as disguised Latin."""
    word = unicodedata.normalize("NFKC", word)
    if IN_SCRIPT["cyrillic"].search(word):
        word = word.translate(LOOKALIKES) if LATIN.search(word) else word.upper().translate(TABLES["cyrillic"])
    if IN_SCRIPT["greek"].search(word):
        word = strip_marks(word).upper().translate(TABLES["greek"])
    if IN_SCRIPT["arabic"].search(word):
        word = HARAKAT.sub("", word).translate(TABLES["arabic"])
    if IN_SCRIPT["hebrew"].search(word):
        word = NIQQUD.sub("", word).translate(TABLES["hebrew"])
    return word


def normalize(raw: str | None) -> str:
    s = raw or ""
    if not s.isascii():
        s = "".join(p if p.isspace() else fold_word(p) for p in re.split(r"(\s+)", s))
    s = DROP.sub(" ", strip_marks(s).upper())
    return " ".join(SEAM.sub(" ", s).split())


def tokens(raw: str | None, lexicon: Lexicon = EMPTY) -> list[str]:
    words = normalize(raw).split()
    for title in lexicon.titles:
        if len(words) > len(title) and tuple(words[: len(title)]) == tuple(title):
            words = words[len(title) :]
            break
    kept = [lexicon.canon.get(w, w).upper() for w in words if w not in lexicon.strip]
    return kept or words


def has_other_script(s: str | None) -> bool:
    return bool(s) and any(r.search(s) for r in IN_SCRIPT.values())


def norm_name(col: Column) -> Column:
    """normalize() as a column: native for ASCII, an Arrow UDF otherwise."""
    plain = F.trim(F.regexp_replace(F.upper(col), "[^A-Z0-9]+", " "))
    other = F.udf(normalize, "string", useArrow=True)(col)
    return F.when(col.isNull(), F.lit("")).when(~col.rlike(r"[^\x00-\x7F]"), plain).otherwise(other)


def name_tokens(col: Column, lexicon: Lexicon = EMPTY) -> Column:
    """tokens() as a column; without a lexicon ASCII stays native."""
    if lexicon == EMPTY:
        return F.filter(F.split(norm_name(col), " "), lambda x: x != "")
    return F.udf(lambda s: tokens(s, lexicon), "array<string>", useArrow=True)(col)


def reading_order(col: Column | str) -> Column:
    """What names sort by for a reader: accents and case tell equal letters apart only."""
    return F.collate(F.col(col) if isinstance(col, str) else col, "UNICODE")


def id_key(col: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(col.cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def other_script(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike("[" + "".join(RANGES.values()) + "]")
