"""URL rules, native: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL gives its host's suffixes (at label borders) with its path's prefixes (at
slashes), of those numbers of labels and folders that some rule has: others fit none. A
rule is filed under its host and its path up to the last slash; the short prefix (32 bits of a 64-bit hash) is the equi-join key, the full SHA-256 digest
and the rest of the rule's path confirm a match, and the longest rule wins. The rules are
broadcast only after their bytes are counted against a bound; beyond it the join is
shuffled, with the prefix salted, so that a host with a third of the rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import ascii_lower

#: The rules of the registered query: fixed values of its contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def folders_of(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/")))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Host suffix and path prefix for each shape (labels, folders) that host and path have, the prefix up to a slash.

    One pass over the URL a shape, so the work grows with its length and not with a power of it.
    """
    if not shapes:
        return F.array().cast("array<string>")
    listed = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(f).alias("folders")) for n, f in shapes])
    fitting = F.filter(listed, lambda s: (s["labels"] <= labels_of(host)) & (s["folders"] <= folders_of(path)))
    folder = lambda n: F.when(n > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/"))).otherwise(F.lit(""))
    return F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.lit(" "), folder(s["folders"])))


def short_prefix(expression: Column) -> Column:
    return F.shiftright(F.xxhash64(expression), 32).cast("int")


def filter_urls(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", id_cols: tuple[str, ...] = (), default: str = "allow", broadcast_bytes: int = 32 << 20, salts: int = 32
) -> DataFrame:
    """id_cols, host, path, rule and verdict of every row of urls.

    rules: host, path, verdict; a rule fits its host and all its subdomains, if the
    url's path starts with the rule's. The longest rule wins, of equal ones the smallest
    text; a rule given twice counts once, with the smaller verdict. Rules with a null are
    left out; both hosts are compared with A-Z lower-cased. A url that is null or without '://' has an empty host and path, fits no rule
    and gets the default. Repeated rows stay as often as they come; nulls in id_cols stay. Urls of any
    length are judged whole; only as many expressions as rules have depths are made of
    one. Empty tables of urls or rules do no harm; columns of urls besides the ones named
    are ignored, whatever their names.
    """
    filed = rules.select(ascii_lower(F.col("host")).alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv")).where("_rh IS NOT NULL AND _rp IS NOT NULL AND _rv IS NOT NULL")
    filed = filed.groupBy("_rh", "_rp").agg(F.min("_rv").alias("_rv"))
    folder = F.regexp_extract("_rp", r"(?s)^(.*/)?", 0)
    filed = filed.select(
        F.concat("_rh", F.lit(" "), folder).alias("_e"), F.expr("substr(_rp, length(regexp_extract(_rp, '(?s)^(.*/)?', 0)) + 1)").alias("_rest"), F.concat("_rh", "_rp").alias("_rule"), "_rv", "_rp", "_rh"
    )
    filed = filed.select(short_prefix(F.col("_e")).alias("_short"), F.sha2("_e", 256).alias("_full"), "_rest", "_rule", "_rv", "_rp", labels_of(F.col("_rh")).alias("_labels"), folders_of(F.col("_rp")).alias("_folders"))
    shapes = sorted(tuple(r) for r in filed.select("_labels", "_folders").distinct().collect())  # a row a depth of rules
    filed = filed.drop("_labels", "_folders")
    counted = filed.agg(F.sum(F.octet_length("_rule") + F.octet_length("_rest") + F.octet_length("_rp") + 128)).first()[0] or 0

    ids = [F.col(f"`{c}`").alias(f"_id{i}") for i, c in enumerate(id_cols)]
    keys = [f"_id{i}" for i in range(len(ids))] + ["_url"]
    asked = urls.select(*ids, F.col(f"`{url_col}`").alias("_url"))
    split = asked.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))}).where("_host != ''")
    split = split.select(*keys, "_path", F.explode(expressions(F.col("_host"), F.col("_path"), shapes)).alias("_expr")).withColumn("_short", short_prefix(F.col("_expr")))
    if counted <= broadcast_bytes:
        joined = split.join(F.broadcast(filed), "_short")
    else:
        split = split.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
        joined = split.join(filed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_short", "_salt"])
    fits = joined.where((F.sha2("_expr", 256) == F.col("_full")) & F.col("_path").startswith(F.col("_rp")))
    match = F.struct((-F.char_length("_rule")).alias("n"), F.col("_rule").alias("rule"), F.col("_rv").alias("verdict"))
    found = fits.select(*keys, match.alias("_m"), F.lit(0).alias("_one"))
    every = asked.select(*keys, F.lit(None).cast(found.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_one"))
    best = every.unionAll(found).groupBy(*keys).agg(F.min("_m").alias("_m"), F.sum("_one").cast("int").alias("_n"))
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return best.select(
        *[F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)],
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_m.rule").alias("rule"),
        F.coalesce("_m.verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules, id_cols=("page_id",))


OP3_SQL = r"""
WITH rules(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT row_number() OVER (ORDER BY page_id, url) AS rid, page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), m AS (
  SELECT u.rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY u.rid ORDER BY length(rh || rp) DESC, rh || rp) AS rn
  FROM u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.rv, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rid = m.rid AND m.rn = 1
"""
