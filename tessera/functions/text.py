"""Column expressions over text: tokens, numbers, masks, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never tell tables or columns apart.
TOKEN_STOPWORDS = ("the", "of", "and", "or", "to", "a", "an", "in", "for", "by")
#: Words of a question that name nothing.
QUESTION_STOPWORDS = tuple(
    "a an and are as at be by for from has have how in is it its of on or that the their this to was what when where which with over per each "
    "most least total number show find give list".split()
)
#: Column-name suffixes that say "key" and nothing else, in the order they are tried.
GENERIC_SUFFIXES = ("id", "code", "key", "no", "num", "number", "pk", "fk", "idx", "index", "name")


def _without(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def entity_tokens(text: Column) -> Column:
    """Lower-case alphanumeric words that begin with a letter, without stopwords, in order, repeats included."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    return _without(F.transform(words, F.lower), TOKEN_STOPWORDS)


def question_tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of a question that have `least` characters and name something."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(_without(words, QUESTION_STOPWORDS), lambda w: F.length(w) >= least))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of an identifier, generic key words left out."""
    words = F.regexp_extract_all(F.lower(camel_split(F.coalesce(name, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(_without(words, GENERIC_SUFFIXES))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def names_correspond(a: Column, b: Column) -> Column:
    """Equal after normalisation, and three characters remain once one generic suffix is gone."""
    plain = normal_name(a)
    cut = F.coalesce(*[F.when(plain.endswith(s), F.length(plain) - len(s)) for s in GENERIC_SUFFIXES], F.length(plain))
    return (plain != "") & (plain == normal_name(b)) & (cut >= 3)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for corresponding names, else the Jaccard share of their tokens."""
    ta, tb = name_tokens(a), name_tokens(b)
    shared = F.size(F.array_intersect(ta, tb)).cast("double")
    return F.when(names_correspond(a, b), 1.0).when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(shared / F.size(F.array_union(ta, tb)))


def normal_answer(text: Column) -> Column:
    """Trimmed, lower-case, one space between words, quotes at the ends removed."""
    out = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")
    for quote in ('"', "'", "`"):
        out = F.regexp_replace(out, f"^{quote}+|{quote}+$", "")
    return out


def humanise(name: Column) -> Column:
    """An identifier as words: camel case and underscores become spaces, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\-]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def plain_numbers(text: Column) -> Column:
    """Signed decimals as they stand."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def fact_numbers(text: Column) -> Column:
    """Signed decimals, commas between digits taken for thousands marks."""
    return plain_numbers(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d),(?=\d)", ""))


def close(x: Column, y: Column, share: float = 0.01) -> Column:
    """x within `share` of y; near zero within a millionth."""
    return F.when(F.abs(y) < 1e-9, F.abs(x) < 1e-6).otherwise(F.abs(x - y) <= share * F.abs(y))


def mask_literals(sql: Column) -> Column:
    """A query without its data: strings, IN lists and numbers become placeholders."""
    out = F.regexp_replace(F.coalesce(sql, F.lit("")), "'(?:''|[^'])*'", "'<value>'")
    out = F.regexp_replace(out, r"(?i)\bIN\s*\((?!\s*SELECT\b)[^)]*\)", "IN (<values>)")
    return F.regexp_replace(out, r"(?<![\w.])[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?![\w.])", "<number>")


def is_metadata_query(sql: Column) -> Column:
    """Statements that ask for the catalog, not for data."""
    return F.regexp_like(F.lower(F.trim(F.coalesce(sql, F.lit("")))), F.lit(r"^\s*(pragma|show|describe|desc|explain)\b|^\.(tables|schema)|sqlite_master|information_schema"))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def think_block(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)<think>(.*?)</think>", 1)


def visible_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""))


def scrub_paths(text: Column) -> Column:
    """Paths of four or more parts are cut to the file's name."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:/[\w.\-]+){3,}/([\w.\-]+)", "$1")


def file_references(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\w\-]+\.(?:csv|tsv|xlsx|xls|md|sqlite|db|json|txt)\b"), F.lit(0)))


def cut_to(text: Column, most: int, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def normal_output(text: Column) -> Column:
    """No blanks at line ends, none around the whole."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)[ \t\r]+$", ""), r"^\s+|\s+$", "")


def short_hash(text: Column, length: int = 12, kind: str = "sha1") -> Column:
    """The first hex digits of a digest: sha1 for result fingerprints, sha256 for ids and state keys."""
    return F.substring(F.sha1(text) if kind == "sha1" else F.sha2(text, 256), 1, length)


def state_key(env: Column, schema_digest: Column, tables: Column, errors: Column, goal: Column) -> Column:
    """A state's canonical key: environment, schema, sorted tables, the last three errors, the goal."""
    last = F.when(F.size(errors) > 3, F.slice(errors, -3, 3)).otherwise(errors)
    return short_hash(F.concat_ws("|", env, schema_digest, F.array_join(F.array_sort(tables), ","), F.array_join(last, ","), goal), 16, "sha256")


def quoted(text: Column) -> Column:
    """A pattern that matches the text as it stands."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def contains_value(text: Column, value: Column) -> Column:
    """A hidden value stands in the text as a token of its own; one-letter words do not count."""
    plain, trimmed = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.trim(value))
    exact = quoted(trimmed)
    numeric = F.regexp_like(trimmed, F.lit(r"^-?\d+(?:\.\d+)?$"))
    number = F.regexp_like(plain, F.concat(F.lit(r"(?<![\w.])"), exact, F.lit(r"(?![\w.])")))
    word = (F.length(trimmed) >= 2) & F.regexp_like(plain, F.concat(F.lit(r"(?<!\w)"), exact, F.lit(r"(?!\w)")))
    return F.when(trimmed == "", False).when(numeric, number).otherwise(word)
