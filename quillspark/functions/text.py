"""Scalar text functions: query cleaning, n-grams, identifiers and URIs. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the index analyser.
ANALYSER_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Characters that stay as they are in an entity URI, besides letters and digits.
URI_SAFE = "!$&'()*+,-./:;=@_~"


def preprocess(text: Column) -> Column:
    """P-01: only letters and digits; the words OR and AND between blanks go; single blanks."""
    spaced = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    for word in (" OR ", " AND "):
        spaced = F.replace(spaced, F.lit(word), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def query_content(text: Column) -> Column:
    """P-02: preprocessed and lower-cased."""
    return F.lower(preprocess(text))


def plain(text: Column) -> Column:
    """Whether query_content only lower-cases text, and texts of that kind that single blanks join; false for null."""
    one = text.rlike(r"\A[A-Za-z0-9]+( [A-Za-z0-9]+)*\z") & ~text.rlike(r"(\A| )(OR|AND)( |\z)")
    return F.coalesce(one, F.lit(False))


def words(text: Column) -> Column:
    """Whitespace terms; an empty or blank text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def remove_stop_words(text: Column, stop: list[str]) -> Column:
    """P-03: drops terms of the set, keeping repeats of others."""
    listed = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.array_join(F.filter(words(text), lambda w: ~F.array_contains(listed, w)), " ")


def analysed(text: Column, stop: list[str] | None = None) -> Column:
    """P-04: lower-cased runs of letters and digits without stop words, as the index sees them.

    Apostrophes split here, where a full word-break analyser keeps them inside a term.
    """
    stop = ANALYSER_STOP_WORDS if stop is None else stop
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    listed = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(terms, lambda w: ~F.array_contains(listed, w))


def ngrams(content: Column, most: int | None = None) -> Column:
    """P-05, P-06: array of (n, start, mention), by length (up to most, if given) and then place; repeats stay."""
    kind = "array<struct<n:int,start:int,mention:string>>"

    def grams(w: Column) -> Column:
        longest = F.size(w) if most is None else F.least(F.size(w), F.lit(most))
        sizes = F.sequence(F.lit(1), longest)
        one = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(n.alias("n"), i.alias("start"), F.array_join(F.slice(w, i + 1, n), " ").alias("mention")))
        return F.when(longest > 0, F.flatten(F.transform(sizes, one))).otherwise(F.array().cast(kind))

    return F.transform(F.array(words(content)), grams)[0]  # the words are split once


def runs(w: Column, n: int) -> Column:
    """P-05: the n-grams of an array of words in their order; repeats stay."""
    one = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]) if n <= 8 else F.array_join(F.slice(w, i + 1, n), " ")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).otherwise(F.array().cast("array<string>"))


def freebase_id_to_uri(c: Column, strict: bool = True) -> Column:
    """P-07: /m/x to <fb:m.x>; anything else raises, or is null if not strict."""
    other = F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(c.startswith("/m/"), F.concat(F.lit("<fb:m."), F.substring(c, 4, 1 << 30), F.lit(">"))).otherwise(other)


def freebase_uri_to_id(c: Column, strict: bool = True) -> Column:
    other = F.raise_error(F.concat(F.lit("not a URI: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(c.startswith("<fb:m.") & c.endswith(">"), F.concat(F.lit("/m/"), F.regexp_extract(c, r"^<fb:m\.(.*)>$", 1))).otherwise(other)


def wiki_to_dbpedia(c: Column) -> Column:
    return F.regexp_replace(c, "^<wikipedia:", "<dbpedia:")


def dbpedia_to_wiki(c: Column) -> Column:
    return F.regexp_replace(c, "^<dbpedia:", "<wikipedia:")


def is_dbpedia_uri(c: Column) -> Column:
    return c.startswith("<dbpedia:") & c.endswith(">")


def is_uri(c: Column) -> Column:
    return c.startswith("<") & c.endswith(">")


def wiki_url_to_uri(url: Column) -> Column:
    """P-09: what follows the last /wiki/, percent-encoded but for URI_SAFE, as a URI."""
    name = F.url_encode(F.regexp_extract(url, r"(?s)^.*/wiki/(.*)$", 1))
    name = F.replace(name, F.lit("+"), F.lit("%20"))
    for ch in URI_SAFE:
        if ch not in "-._*":
            name = F.replace(name, F.lit("%{:02X}".format(ord(ch))), F.lit(ch))
    return F.when(F.contains(url, F.lit("/wiki/")), F.concat(F.lit("<dbpedia:"), name, F.lit(">")))


def resolve_uri(c: Column) -> Column:
    """P-10: percent-decoded; of <a:b:c> what follows the last colon, underscores as blanks."""
    raw = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.when(is_uri(raw), F.replace(F.regexp_extract(raw, r"(?s)^<(?:.*:)?(.*)>$", 1), F.lit("_"), F.lit(" "))).otherwise(raw)


def field_values(values: Column, only_uris: bool = False) -> Column:
    """P-11: resolved values, or only those that are entity URIs, as they are."""
    return F.filter(values, is_dbpedia_uri) if only_uris else F.transform(values, resolve_uri)


def is_disambiguation(uri: Column) -> Column:
    """P-12."""
    return F.coalesce(uri.endswith("_(disambiguation)>"), F.lit(False))


def session_of(q_id: Column) -> Column:
    """P-14: the id up to its last underscore, or all of it."""
    return F.regexp_replace(q_id, "_[^_]*$", "")


def index_query(text: Column) -> Column:
    """P-15: without brackets and exclamation marks, then analysed without stop words."""
    return analysed(F.translate(text, "()!", ""))


def escape_key(c: Column) -> Column:
    """P-13: keys of a document store, with its two reserved characters spelt as fullwidth ones."""
    return F.translate(c, ".$", "．＄")


def unescape_key(c: Column) -> Column:
    return F.translate(c, "．＄", ".$")


def prefixed(uri: Column, prefixes: dict[str, str]) -> Column:
    """P-13: <http://long/name> to <short:name> by the longest known start; others stay."""
    out = uri
    for start, short in sorted(prefixes.items(), key=lambda x: len(x[0])):
        out = F.when(uri.startswith("<" + start), F.concat(F.lit(f"<{short}:"), F.expr(f"substr({_name(uri)}, {len(start) + 2})"))).otherwise(out)
    return out


def _name(c: Column) -> str:
    return c._jc.toString()


def relabel(score: Column, threshold: float) -> Column:
    """P-17."""
    return F.when(score >= threshold, "1").otherwise("0")


def mlm_weights(names: float, links: float, contents: float) -> dict[str, float]:
    """P-19: field weights without the zero ones."""
    return {k: v for k, v in {"names": names, "links": links, "contents": contents}.items() if v}


def run_id(method: str, **options) -> str:
    """P-18."""
    return "-".join([method, *[f"{k}{v:g}" if isinstance(v, float) else f"{k}{v}" for k, v in sorted(options.items()) if v is not None]])
