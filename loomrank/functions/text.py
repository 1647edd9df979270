"""Text functions on columns: normalisation, tokens, numbers, n-grams, slugs, phrases, spans.

All are built-in expressions; the three that keep state along a text (``phrases_replace``,
``sequence_similarity``, ``align_span``) are Arrow-batched UDFs.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

# Fixed values that results depend on.
WORD = r"[a-záéíóúüñ]+|\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?"
NUMBER = r"\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?"
SLUG = r"[a-záéíóúüñ0-9]+"
INDEX_TOKEN = r"[\p{L}\p{N}_]+"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
VOWELS, PLAIN_VOWELS = "áéíóúü", "aeiouu"
STOP_WORDS = ("de", "la", "el", "en", "y", "a", "los", "las", "del", "con", "por", "para", "un", "una", "al", "o")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str, absorb_space: bool = False) -> Column:
    """Lower case, thousands dots dropped, decimal commas to dots, a space before %, one space between words.

    ``absorb_space``: the variant for generated texts, which puts one space before every %.
    """
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    x = F.regexp_replace(x, r"(?<=\d)\.(?=\d{3}\b)", "")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d)", ".")
    x = F.regexp_replace(x, r"\s*%", " %") if absorb_space else F.regexp_replace(x, r"(?<=\d)%", " %")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tokenize_words(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0))


def text_word(c: Column | str) -> Column:
    return F.array_join(tokenize_words(c), " ")


def text_char(c: Column | str) -> Column:
    return F.concat(F.lit(" "), _col(c), F.lit(" "))


def number_strings(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))


def extract_numbers(c: Column | str) -> Column:
    """Numbers as doubles; ``4x40`` gives both factors; order and repeats kept."""
    found = F.regexp_extract_all(_col(c), F.lit(NUMBER), F.lit(0))
    return F.transform(F.flatten(F.transform(found, lambda x: F.split(x, "x"))), lambda x: x.cast("double"))


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_col(c), F.lit(r"\S+"), F.lit(0)))


def fold_accents(c: Column | str, vowels_only: bool = False) -> Column:
    return F.translate(F.lower(_col(c)), *((VOWELS, PLAIN_VOWELS) if vowels_only else (ACCENTED, PLAIN)))


def index_tokens(c: Column | str) -> Column:
    """Tokens of the index analyser: lower case, accents folded, runs of letters, digits and underscores."""
    return F.regexp_extract_all(fold_accents(c), F.lit(INDEX_TOKEN), F.lit(0))


def drop_stop_words(tokens: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.isin(*stop_words))


def bigrams(tokens: Column | str, separator: str = " ") -> Column:
    """Adjacent pairs joined by ``separator``; empty below two tokens."""
    t = _col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(separator), b))


def uni_bi(tokens: Column | str, separator: str = " ") -> Column:
    return F.concat(_col(tokens), bigrams(tokens, separator))


def char_words(c: Column | str) -> Column:
    """The words of ``char_wb``, padded by one space on either side."""
    return F.transform(
        F.filter(F.split(fold_accents(c), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    )


def char_windows(word: str, low: int = 3, high: int = 5) -> list[str]:
    """The character n-grams of one of ``char_words``."""
    return [word[i : i + n] for n in range(low, high + 1) for i in range(len(word) - n + 1)]


def char_wb(c: Column | str, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each word padded by one space on either side."""
    padded = char_words(c)

    def windows(w: Column, n: int) -> Column:
        return F.when(
            F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*(windows(w, n) for n in range(low, high + 1)))))


def slug_words(c: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(_col(c)), F.lit(SLUG), F.lit(0)), "_")


def snake_merge(c: Column | str) -> Column:
    return F.array_join(tokenize_words(c), "_")


def canon_comparators(c: Column | str) -> Column:
    x = _col(c)
    for a, b in (("≥", ">="), ("≤", "<="), (">=", " ge "), ("<=", " le "), (">", " gt "), ("<", " lt ")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def param_token(label: Column | str, value: Column | str) -> Column:
    """``param_<label>_<value>`` of slugs; an empty slug becomes label or value."""

    def part(c: Column | str, default: str) -> Column:
        s = slug_words(canon_comparators(c))
        return F.when(s == "", default).otherwise(s)

    return F.concat_ws("_", F.lit("param"), part(label, "label"), part(value, "value"))


def phrases_add(tokens: Column | str, phrases: Column | str) -> Column:
    return F.concat(_col(tokens), _col(phrases))


def sort_phrases(phrases: Column | str) -> Column:
    """Distinct phrases, most parts first, then alphabetical."""
    key = F.transform(F.array_distinct(_col(phrases)), lambda p: F.struct((-F.size(F.split(p, "_"))).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(key), lambda s: s["p"])


def replace_phrases(tokens: list[str], phrases: list[str]) -> list[str]:
    """Longer phrases first, leftmost non-overlapping occurrences merged; phrases not found are appended."""
    taken, merged, missing = [False] * len(tokens), {}, []
    for phrase in phrases:
        parts = phrase.split("_")
        n, hit = len(parts), False
        i = 0
        while i + n <= len(tokens):
            if tokens[i : i + n] == parts and not any(taken[i : i + n]):
                taken[i : i + n] = [True] * n
                merged[i] = (phrase, n)
                hit = True
                i += n
            else:
                i += 1
        if not hit:
            missing.append(phrase)
    out, i = [], 0
    while i < len(tokens):
        phrase, n = merged.get(i, (tokens[i], 1))
        out.append(phrase)
        i += n
    return out + missing


@F.pandas_udf(ArrayType(StringType()))
def phrases_replace(tokens: pd.Series, phrases: pd.Series) -> pd.Series:
    none: list[str] = []
    return pd.Series([replace_phrases(list(none if t is None else t), list(none if p is None else p)) for t, p in zip(tokens, phrases)])


def parent_prefix(c: Column | str, n: int = 6) -> Column:
    return F.substring(_col(c), 1, n)


def parse_k1_b(c: Column | str) -> tuple[Column, Column]:
    """k1 and b named in a method name such as ``bm25_k1_0.80_b_0.35``; null where absent."""

    def part(name: str) -> Column:
        return F.regexp_extract(_col(c), name + r"[_=]?(\d+(?:\.\d+)?)", 1).try_cast("double")

    return part("k1"), part(r"(?:^|_)b")


def json_repair(c: Column | str, schema: str = "map<string,string>") -> Column:
    """The object in a model's answer: code fences stripped, trailing commas dropped on a second try, else null."""
    x = F.trim(F.regexp_replace(_col(c), r"```(?:json)?", ""))
    return F.coalesce(F.from_json(x, schema), F.from_json(F.regexp_replace(x, r",\s*([}\]])", "$1"), schema))


def banda_normalize(c: Column | str) -> Column:
    """Canonical comparators, quotes and spacing of an interval label."""
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    x = F.regexp_replace(x, "[\"'´`]", "")
    for a, b in (("≥", ">="), ("≤", "<="), ("=>", ">="), ("=<", "<="), ("<==", "<="), (">==", ">=")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"\s*(<=|>=|<|>)\s*", " $1 ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def numeric_normalize(c: Column | str) -> Column:
    """A number with its unit stripped, comma as decimal point; null if none."""
    x = F.regexp_replace(F.replace(F.lower(_col(c)), F.lit(","), F.lit(".")), "[^0-9.+-]", "")
    return x.try_cast("double")


def numeric_equal(a: Column | str, b: Column | str) -> Column:
    """True if both are the same number without their units; false if either is none."""
    return F.coalesce(numeric_normalize(a) == numeric_normalize(b), F.lit(False))


def normalize_parameters(c: Column | str) -> Column:
    """Struct of norm, the parameter map with label_norm and value_norm beside each label and value, and
    multi, the distinct normalised values of two words or more in order; a null map counts as empty.
    """
    value = lambda v: F.struct(v["label"].alias("label"), v["value"].alias("value"), normalize_text(v["value"]).alias("value_norm"))
    kept = lambda b: F.transform(F.coalesce(b["values"], F.array().cast("array<struct<label:string, value:string>>")), value)
    block = lambda k, b: F.struct(b["label"].alias("label"), normalize_text(b["label"]).alias("label_norm"), kept(b).alias("values"))
    empty = F.from_json(F.lit("{}"), "map<string, struct<label:string, values:array<struct<label:string, value:string>>>>")
    norm = F.transform_values(F.coalesce(_col(c), empty), block)
    values = F.flatten(F.transform(F.map_values(norm), lambda b: b["values"]["value_norm"]))
    words = lambda v: F.size(F.regexp_extract_all(v, F.lit(r"\p{L}+"), F.lit(0)))
    return F.struct(norm.alias("norm"), F.array_distinct(F.filter(values, lambda v: words(v) >= 2)).alias("multi"))


def normalized_levenshtein(a: Column | str, b: Column | str) -> Column:
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(_col(a), _col(b)) / longest)


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(ArrayType(IntegerType()))
def align_span(text: pd.Series, value: pd.Series) -> pd.Series:
    """[start, end) of the leftmost occurrence of a value between non-word neighbours; null if none."""

    def find(t: str | None, v: str | None) -> list[int] | None:
        t, v = " ".join((t or "").split()), " ".join((v or "").split())
        at = t.find(v) if v else -1
        while at >= 0:
            end = at + len(v)
            if not (at and t[at - 1].isalnum()) and not (end < len(t) and t[end].isalnum()):
                return [at, end]
            at = t.find(v, at + 1)
        return None

    return pd.Series([find(t, v) for t, v in zip(text, value)])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def prompt(template: str, **columns: Column | str) -> Column:
    """A prompt from a template with {name} slots filled by columns."""
    out, rest = [], template
    while rest:
        head, _, tail = rest.partition("{")
        out.append(F.lit(head))
        if not tail:
            break
        name, _, rest = tail.partition("}")
        out.append(F.coalesce(_col(columns[name]).cast("string"), F.lit("")))
    return F.concat(*out)


PROMPTS = {
    "extract": "Extract the attributes of the item as a JSON object.\nItem: {text}\n",
    "classify": "Choose one value for every attribute.\nAttributes: {axes}\nItem: {text}\nAnswer in JSON.\n",
    "twostep_find": "List the phrases of the item that state an attribute.\nItem: {text}\n",
    "twostep_map": "Map every phrase to an allowed value.\nPhrases: {phrases}\nAllowed: {axes}\nAnswer in JSON.\n",
    "aware_find": "The item may be worded differently from the catalogue.\nAttributes: {axes}\nItem: {text}\n",
    "aware_map": "Map the findings to the catalogue's wording.\nFindings: {phrases}\nAllowed: {axes}\nAnswer in JSON.\n",
    "strict_find": "Quote only words of the item.\nAttributes: {axes}\nItem: {text}\n",
    "strict_map": "Use null for attributes that the item does not state.\nFindings: {phrases}\nAllowed: {axes}\n",
}

#: Ordered rewrites from catalogue formulas to SQL expressions.
FORMULA_RULES = ((r"\s*<>\s*", " != "), (r"(?i)\bAND\b", " and "), (r"(?i)\bOR\b", " or "), (r"(?i)\bNOT\b", " not "), (r"([\w.$]+|\([^()]*\))\s*\^\s*([\w.$]+|\([^()]*\))", "power($1, $2)"), (r"\$(\w+)", "$1"), (r"\s+", " "))


def formula_to_sql(c: Column | str) -> Column:
    x = _col(c)
    for pattern, to in FORMULA_RULES:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)
