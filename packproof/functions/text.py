"""Line categories, scripts and brand signatures (FN-1 to FN-3, FN-11 to FN-20, FN-27)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C
from .fuzzy import once
from .ids import normalize_indic_digits
from .lookup import by_value
from .patterns import has, java

#: Categories in order of priority, with their patterns.
CATEGORIES = {
    "ingredients": C.INGREDIENTS, "nutrition": C.NUTRITION, "mrp": C.MRP, "quantity": C.QUANTITY, "mfg_date": C.MFG_DATE,
    "batch_number": C.BATCH_NUMBER, "license": C.LICENSE, "helpline": C.HELPLINE, "address": C.ADDRESS,
}


def classify_line(text: Column) -> Column:
    out = None
    for name, pattern in CATEGORIES.items():
        out = F.when(has(text, pattern), name) if out is None else out.when(has(text, pattern), name)
    return out.otherwise("other")


def classify_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``category`` of their text; equal texts are classified once, null ones are ``other``."""
    return by_value(lines.drop("category"), column, {"category": classify_line(F.col("__value"))}).fillna("other", ["category"])


def price_tag(text: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A bare number of 1 to 9999 near the top left reads as a price."""
    number = F.regexp_extract(normalize_indic_digits(text), r"^\s*[^a-zA-Z0-9:ऀ-ൿ]*\s*([0-9]{1,5}(?:\.[0-9]{1,2})?)\s*[^a-zA-Z0-9:ऀ-ൿ]*$", 1).try_cast("double")
    top = F.when(height > 0, y / height).otherwise(1.0) < 0.30
    left = F.when(width > 0, x / width).otherwise(1.0) < 0.45
    return F.coalesce(number.between(1, 9999) & top & left, F.lit(False))


def feature_flags(text: Column, confidence: Column, category: Column) -> Column:
    return F.struct(has(text, C.MISSPELLED).alias("counterfeit_spelling"), (confidence < 0.70).alias("tampering_suspected"), F.concat(F.lit("RL-"), F.upper(category), F.lit("-001")).alias("rule_id"))


#: Blocks in declared order: name, code points, label, language.
SCRIPTS = [
    ("Devanagari", "\\u0900-\\u097F", "", ""), ("Tamil", "\\u0B80-\\u0BFF", "Tamil (தமிழ்)", "ta"), ("Telugu", "\\u0C00-\\u0C7F", "Telugu (తెలుగు)", "te"),
    ("Gujarati", "\\u0A80-\\u0AFF", "Gujarati (ગુજરાતી)", "gu"), ("Bengali", "\\u0980-\\u09FF", "Bengali (বাংলা)", "bn"), ("Kannada", "\\u0C80-\\u0CFF", "Kannada (ಕನ್ನಡ)", "kn"),
    ("Malayalam", "\\u0D00-\\u0D7F", "Malayalam (മലയാളം)", "ml"), ("Gurmukhi", "\\u0A00-\\u0A7F", "Gurmukhi (ਪੰਜਾਬੀ)", "pa"), ("Odia", "\\u0B00-\\u0B7F", "Odia (ଓଡ଼ିଆ)", "or"),
]


def devanagari_language(text: Column) -> Column:
    """mr or hi: glyphs and suffixes decide, else lexicon hits (3 each) and postpositions (2); a tie is Hindi."""
    def hits(phrases):
        return sum((F.contains(text, F.lit(w)).cast("int") * 3 for w in phrases), F.lit(0))

    marathi, hindi = hits(C.MARATHI), hits(C.HINDI) + has(text, C.HINDI_POSTPOSITION, False).cast("int") * 2
    sure = text.rlike("[\\u0933\\u0931\\u095F]") | has(text, C.MARATHI_SUFFIX, False)
    return F.when(sure | (marathi > hindi), "mr").otherwise("hi")


def detect_script(text: Column) -> Column:
    """struct: script, language, is_multilingual, script_family."""
    counts = [F.regexp_count(text, F.lit(f"[{block}]")) for _, block, _, _ in SCRIPTS]
    total, most = sum(counts[1:], counts[0]), F.greatest(*counts)
    latin = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    indic = F.coalesce((most > 0) & ((total >= 2) | (total >= latin * 0.25)), F.lit(False))
    # most texts hold no such character, which one search tells
    indic = F.coalesce(text.rlike("[\\u0900-\\u0D7F]"), F.lit(False)) & indic
    made = lambda script, language, family, multi: F.struct(script.alias("script"), language.alias("language"), F.lit(multi).alias("is_multilingual"), F.lit(family).alias("script_family"))
    latin_struct = made(F.lit("Latin (English)"), F.lit("en"), "Latin", False)
    own = devanagari_language(text)
    out = F.when(~indic, latin_struct).when(counts[0] == most, made(F.when(own == "mr", "Marathi (मराठी)").otherwise("Hindi (हिंदी)"), own, "Devanagari", True))
    for (name, _, label, language), n in list(zip(SCRIPTS, counts))[1:]:
        out = out.when(n == most, made(F.lit(label), F.lit(language), name, True))
    return out.otherwise(latin_struct)


def is_latin_hallucination(text: Column, confidence: Column) -> Column:
    letters = F.regexp_replace(text, "[^a-zA-Z]", "")
    consonants = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
    return (
        F.when(F.coalesce(text, F.lit("")) == "", True)
        .when(~text.rlike("[a-zA-Z0-9\\u0900-\\u0D7F]"), True)
        .when(text.rlike("(?i)^[lI1|:;~_\\-.]{2,}$"), True)
        .when(letters == "", False)
        .when(F.lower(letters).isin(*C.ACRONYMS) | text.rlike("\\p{Nd}"), False)
        .when(has(letters, C.GARBLED), True)
        .when(~letters.rlike("[aeiouyAEIOUY]") & (F.length(letters) >= 2), True)
        .when((F.length(letters) <= 2) & (confidence < 0.75), True)
        .when(letters.rlike(f"([{consonants}])\\1") & (confidence < 0.88), True)
        .when(letters.rlike(f"^[{consonants}]{{2,}}") & (confidence < 0.85), True)
        .otherwise(False)
    )


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def prune_crosstalk(text: Column) -> Column:
    """Stray Latin goes from Devanagari text, a stray Devanagari sign from Latin text; counts are taken first."""
    counts = lambda t: F.struct(F.regexp_count(t, F.lit("[\\u0900-\\u097F]")).alias("dev"), F.regexp_count(t, F.lit("[A-Za-z]")).alias("latin"))
    stripped = lambda t: _tidy(F.regexp_replace(F.regexp_replace(t, "[a-zA-Z]+", ""), "[,|._\\-~`'\"!?:]", ""))
    bare = lambda t: _tidy(F.regexp_replace(t, "[\\u0900-\\u097F]", ""))
    unless_empty = lambda made, other: once(made, lambda m: F.coalesce(F.nullif(m, F.lit("")), other))

    def pruned(t: Column, n: Column) -> Column:
        first = F.when(n["dev"] >= 1, unless_empty(stripped(t), t)).otherwise(t)
        second = _tidy(F.regexp_replace(first, "[\\u200B-\\u200D\\uFEFF]", ""))
        return once(second, lambda x: F.when((n["latin"] >= 4) & (n["dev"] <= 1), unless_empty(bare(x), x)).otherwise(x))

    return once(text, lambda t: F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(once(counts(t), lambda n: pruned(t, n))))


def _unicode(form: str, drop_marks: bool):
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        def one(t):
            t = unicodedata.normalize(form, t)
            return "".join(c for c in t if not unicodedata.combining(c)) if drop_marks else t

        return texts.map(one, na_action="ignore")

    return normal


def arbitrate(latin_text: Column, latin_conf: Column, dev_text: Column, dev_conf: Column) -> Column:
    """struct text, confidence: the better of two readings of one crop."""
    nfkc = _unicode("NFKC", False)
    read = F.struct(F.trim(nfkc(F.coalesce(latin_text, F.lit("")))).alias("latin"), F.trim(nfkc(F.coalesce(dev_text, F.lit("")))).alias("dev"))

    def judged(t: Column) -> Column:
        signs, letters = F.regexp_count(t["dev"], F.lit("[\\u0900-\\u0D7F]")), F.regexp_count(t["latin"], F.lit("[A-Za-z0-9]"))
        return F.struct(t["latin"].alias("latin"), t["dev"].alias("dev"), is_latin_hallucination(t["latin"], latin_conf).alias("garbled"), detect_script(t["dev"])["is_multilingual"].alias("indic"), signs.alias("signs"), letters.alias("letters"))

    def chosen(t: Column) -> Column:
        latin, dev, garbled, indic, signs, letters = (t[c] for c in ("latin", "dev", "garbled", "indic", "signs", "letters"))
        take = lambda text, conf: F.struct(text.alias("text"), conf.alias("confidence"))
        both = F.greatest(latin_conf, dev_conf)
        sound = ~garbled & (latin_conf >= 0.70) & (letters >= 2)
        return (
            F.when(sound & indic & (signs >= 3) & (dev_conf > 0.85) & (latin_conf < 0.80), take(dev, dev_conf))
            .when(sound, take(latin, latin_conf))
            .when(garbled & indic & (signs >= 1) & (dev_conf >= 0.25), take(dev, both))
            .when(garbled & (F.length(dev) > 0) & (dev_conf > latin_conf), take(dev, dev_conf))
            .when(indic & (signs >= 2) & (dev_conf >= 0.35) & ((latin_conf < 0.70) | (dev_conf >= latin_conf)), take(dev, both))
            .when(indic & (signs <= 1) & (letters >= 1), take(latin, latin_conf))
            .when(indic & (signs >= 2) & (dev_conf >= 0.40), take(dev, dev_conf))
            .otherwise(take(latin, latin_conf))
        )

    # each step is worked out once: written out, the tests would repeat the pruning in every branch
    pruned = once(read, lambda t: F.struct(t["latin"].alias("latin"), prune_crosstalk(t["dev"]).alias("dev")))
    return once(once(pruned, judged), chosen)


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalize_homoglyphs(text: Column, plain: bool = False) -> Column:
    """Look-alike characters as Latin letters. Only texts beyond ASCII pass the Unicode helper; ``plain`` has none of them."""
    base = text if plain else F.when(text.rlike("[^\\x00-\\x7F]"), _unicode("NFKD", True)(text)).otherwise(text)
    out = F.translate(F.lower(base), "".join(C.HOMOGLYPHS), "".join(C.HOMOGLYPHS.values()))
    return F.trim(F.regexp_replace(_replaced(out, C.HOMOGLYPH_PAIRS), "[^a-z0-9\\s]", ""))


def normalize_digraphs(text: Column) -> Column:
    out = F.regexp_replace(_replaced(F.trim(F.lower(text)), C.DIGRAPHS), "(.)\\1+", "$1")
    return F.regexp_replace(out, "[^a-z0-9]", "")


def soundex_in(text: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y all end a run of one code."""
    w = F.upper(F.trim(text))
    for start, to in (("^PH", "F"), ("^WR", "R"), ("^KN", "N")):
        w = F.regexp_replace(w, start, to)
    w = _replaced(w, [("PH", "F"), ("GH", "G"), ("SH", "S"), ("CH", "C"), ("BH", "B"), ("KH", "K"), ("TH", "T"), ("DH", "D")])
    w = F.regexp_replace(w, "[^A-Z]", "")
    codes = F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.replace(F.substring(F.regexp_replace(codes, "(.)\\1+", "$1"), 2, 100_000), F.lit("0"), F.lit(""))
    return F.when(F.coalesce(w, F.lit("")) == "", "0000").otherwise(F.rpad(F.concat(F.left(w, F.lit(1)), rest), 4, "0"))


def metaphone_in(text: Column) -> Column:
    """Up to six letters of a simplified phonetic code."""
    w = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z]", "")
    w = F.regexp_replace(w, "^(?:K(N)|G(N)|P(N)|A(E)|W(R))", "$1$2$3$4$5")
    w = _replaced(w, [("PH", "F"), ("BH", "B"), ("KH", "K"), ("DH", "D")])
    w = F.regexp_replace(w, "MB$", "M")
    w = _replaced(w, [("SCH", "SK"), ("CIA", "X"), ("TCH", "CH"), ("CH", "X"), ("SH", "X"), ("TH", "0")])
    w = F.replace(F.regexp_replace(w, "C(?=[EIY])", "S"), F.lit("C"), F.lit("K"))
    w = _replaced(F.regexp_replace(w, "G(?=[EIY])", "J"), [("Q", "K"), ("X", "KS"), ("Z", "S"), ("V", "F"), ("W", "F")])
    # vowels after the first letter go, then equal neighbours become one
    tail = F.regexp_replace(F.substring(w, 2, 100_000), "[AEIOU]", "")
    code = F.regexp_replace(F.concat(F.left(w, F.lit(1)), tail), "(.)\\1+", "$1")
    return F.coalesce(F.left(code, F.lit(6)), F.lit(""))


def brand_ngrams(text: Column) -> Column:
    """The whole text, then each word with its two followers, first seen first, two characters or more."""
    low = F.lower(F.trim(text))
    tokens = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda m: k + m <= n), lambda m: F.array_join(F.slice(tokens, k + 1, m), " ")))
    every = F.when(n > 0, F.concat(F.array(low), F.flatten(runs))).otherwise(F.array(low))
    return F.filter(F.array_distinct(every), lambda s: F.length(s) >= 2)


#: Display labels of categories.
LABELS = {
    "brand_logo": "Brand Trademark & Logo", "mrp": "Retail Price (MRP)", "quantity": "Net Quantity", "address": "Manufacturer Address", "helpline": "Consumer Helpline",
    "license": "FSSAI / BIS License", "mfg_date": "Date of Mfg & Expiry", "nutrition": "Nutritional Facts", "origin": "Country of Origin", "ingredients": "Ingredients List",
}


def category_label(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, category), F.upper(F.replace(category, F.lit("_"), F.lit(" "))))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "F", "C", "pd", "unicodedata", "java", "has")]
