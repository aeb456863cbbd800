"""Words: folding, tokens, quoted phrases, wildcards, stop words."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Latin-1 and what folding makes of them.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"

#: A term that is one of these words alone is dropped from a search.
STOP_WORDS = """
a about actually almost also although always am an and any are as at be became become but by can could did do does each either else
for from had has have he her hers hence him his how i if in into is it its just like may maybe me might mine must my neither nor not of oh ok
out over she the them these those under when where whereas wherever whenever whether which while who whom whoever whose why will with within
without would yes yet you your yours
""".split()

NOT_WORD, WORD = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without accents.

    translate looks each character up; texts whose characters are all of one byte have nothing to look up.
    """
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


def fold_all(text: Column) -> Column:
    """Folded, with punctuation and white space runs as one blank: what keyword search compares."""
    return F.trim(F.regexp_replace(fold(text), NOT_WORD, " "))


def stem(token: Column) -> Column:
    """A light English suffix stemmer for folded tokens: plural s/es/ies, then ing, ed, ly, while at least three letters stay."""
    t = F.when(token.rlike(r"^.{2,}ies$"), F.regexp_replace(token, "ies$", "y")).when(token.rlike(r"^.{2,}(ss|x|ch|sh)es$"), F.regexp_replace(token, "es$", "")).when(token.rlike(r"^.{2,}[^s]s$"), F.regexp_replace(token, "s$", "")).otherwise(token)
    return F.when(t.rlike(r"^.{3,}ing$"), F.regexp_replace(t, "ing$", "")).when(t.rlike(r"^.{3,}ed$"), F.regexp_replace(t, "ed$", "")).when(t.rlike(r"^.{3,}ly$"), F.regexp_replace(t, "ly$", "")).otherwise(t)


def split_words(text: Column) -> Column:
    """Words and quoted phrases of a value, quotes taken off: the operands of an AND."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda w: F.trim(F.translate(w, '"', "")))


def ignorable(value: Column) -> Column:
    """Whether a value is a single stop word or has no letter or digit; such a term is true under AND, false under OR."""
    return ~value.rlike(r"[\p{L}\p{N}]") | F.lower(F.trim(value)).isin(STOP_WORDS)


def normalize_wildcards(value: Column) -> Column:
    """Runs of * and ? that hold a * become one *; null if a word has a wildcard, but none beside three other characters."""
    v = F.regexp_replace(value, r"[*?]*\*[*?]*", "*")
    words = F.filter(F.split(v, r"[\s-]+"), lambda w: w.rlike(r"[*?]"))
    return F.when(F.forall(words, lambda w: w.rlike(r"[*?][^*?]{3}|[^*?]{3}[*?]")), v)


def checked_wildcards(value: str) -> str:
    """normalize_wildcards of one search value; what that makes null is an error."""
    import re

    value = re.sub(r"[*?]*\*[*?]*", "*", value)
    for word in re.split(r"[\s-]+", value):
        if re.search(r"[*?]", word) and not re.search(r"[*?][^*?]{3}|[^*?]{3}[*?]", word):
            raise ValueError(f"a wildcard needs three other characters beside it: {word!r}")
    return value


def split_trim(text: Column, by: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, by), lambda x: F.trim(x)), lambda x: x != "")


def camel_words(text: Column) -> Column:
    """camelCase as lower-case words."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def to_first_capital(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^A-Z]*)", 1)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def fill(template: Column, **values: Column) -> Column:
    """%name placeholders replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"%{name}"), value)
    return template


def encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def page_link(base: Column, kind: str, scope: Column, criteria: Column, page: Column, length: Column) -> Column:
    """Link text of a search, estimate, facet or list page."""
    return F.concat(base, F.lit(f"/{kind}/"), scope, F.lit("?q="), encoded(criteria), F.lit("&page="), page.cast("string"), F.lit("&pageLength="), length.cast("string"))


def facet_link(base: Column, scope: Column, facet: Column, criteria: Column, page: Column) -> Column:
    return F.concat(base, F.lit("/facets/"), scope, F.lit("/"), facet, F.lit("?q="), encoded(criteria), F.lit("&page="), page.cast("string"))


def estimate_link(base: Column, scope: Column, criteria: Column) -> Column:
    return F.concat(base, F.lit("/search-estimate/"), scope, F.lit("?q="), encoded(criteria))


def list_link(base: Column, scope: Column, name: Column, uri: Column) -> Column:
    """A related list: its name and the record it belongs to."""
    return F.concat(base, F.lit("/related-list/"), scope, F.lit("?name="), encoded(name), F.lit("&uri="), encoded(uri))


def array_merge(a: Column, b: Column) -> Column:
    """Values of both, each once, those of a first."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def array_remove_all(a: Column, b: Column) -> Column:
    """Values of a that b lacks."""
    return F.array_except(a, b)


def array_difference(a: Column, b: Column) -> Column:
    """Values that only one of the two has."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def to_number(text: Column, name: str = "value") -> Column:
    """A double, or an error that names the value."""
    n = text.try_cast("double")
    return F.when(text.isNull() | n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no number: "), text)).cast("double"))


def arrays_equal(a: Column, b: Column) -> Column:
    """The same values in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def array_swap(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x == old, new).otherwise(x))
