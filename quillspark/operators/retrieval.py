"""Fielded index and language-model scoring.

Index tables: postings (doc_id, field, term, tf), lengths (doc_id, field, len),
terms (field, term, ctf, df), fields (field, clen, docs, avg_len). Scores are sparse:
a query's background part is added once, and only postings of its terms are touched, so
that no documents are crossed with terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.numbers import rounded
from quillspark.functions.text import ANALYSER_STOP_WORDS, analysed, words
from quillspark.sources.tables import shared_table, small


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    fields: DataFrame
    n_docs: int | None = None

    @classmethod
    def read(cls, spark, path: str) -> Index:
        """K-14: a written index."""
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "terms", "fields")])

    def write(self, path: str) -> Index:
        """K-14: the tables as Parquet, postings in the order of their terms; gives the written index."""
        spark = self.postings.sparkSession
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "terms", "fields"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Index.read(spark, path)


def build_index(values: DataFrame, stop: list[str] | None = None, only: DataFrame | None = None) -> Index:
    """X-01 (last step), A-02, A-03: values (doc_id, field, value), analysed and counted.

    Texts are read and analysed once: postings are written to the shared folder, and the
    other tables are sums over them. only (term): postings and terms of these alone are kept, before the
    shuffle; lengths and fields count all terms, so that scores of queries of these terms are the same.
    """
    stop = ANALYSER_STOP_WORDS if stop is None else stop
    # What analysed() gives, but filtered as rows, in generated code.
    tokens = values.select("doc_id", "field", F.explode(F.split(F.lower("value"), r"[^\p{L}\p{N}]+")).alias("term")).where("term != ''")
    tokens = tokens.where(~F.col("term").isin(stop)) if stop else tokens
    if only is not None:  # all others of a document are one row, without a term
        kept = only.select("term").distinct().withColumn("_kept", F.lit(True))
        tokens = tokens.join(small(kept, F.length("term") + 64), "term", "left").select("doc_id", "field", F.when(F.col("_kept"), F.col("term")).alias("term"))
    postings = shared_table(values.sparkSession, tokens.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    spark = values.sparkSession
    lengths = shared_table(spark, postings.groupBy("doc_id", "field").agg(F.sum("tf").alias("len")), "lengths")
    postings = postings.where("term IS NOT NULL")
    terms = shared_table(spark, postings.groupBy("field", "term").agg(F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df")), "terms")
    fields = lengths.groupBy("field").agg(F.sum("len").alias("clen"), F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    return Index(postings, lengths, terms, fields)


def entity_values(triples: DataFrame, fields: DataFrame, id_prefix: str = "<dbpedia:", must_have: list[str] | None = None, ignore: list[str] | None = None, catch_all: bool = True, id_in_catch_all: bool = True) -> DataFrame:
    """X-01: (doc_id, field, value) of the triples (s, p, o) by the configuration fields (p, field, only_uris).

    Only subjects with the prefix that have all of must_have; a predicate may have several
    rows to be copied to several fields. contents gathers every value but the ignored
    predicates', and the resolved subject itself if id_in_catch_all.
    """
    from quillspark.functions.text import is_dbpedia_uri, resolve_uri

    ours = triples.where(F.col("s").startswith(id_prefix) & (F.trim("o") != ""))
    for p in must_have or []:
        ours = ours.join(ours.where(F.col("p") == p).select("s").distinct(), "s", "left_semi")
    named = ours.join(fields, "p").where(~F.col("only_uris") | is_dbpedia_uri(F.col("o")))
    named = named.select(F.col("s").alias("doc_id"), "field", F.when(F.col("only_uris"), F.col("o")).otherwise(resolve_uri(F.col("o"))).alias("value"))
    if catch_all:
        every = ours.where(~F.col("p").isin(ignore)) if ignore else ours
        named = named.unionByName(every.select(F.col("s").alias("doc_id"), F.lit("contents").alias("field"), resolve_uri(F.col("o")).alias("value")))
        if id_in_catch_all:
            named = named.unionByName(ours.select("s").distinct().select(F.col("s").alias("doc_id"), F.lit("contents").alias("field"), resolve_uri(F.col("s")).alias("value")))
    return named.where(F.coalesce(F.col("value"), F.lit("")) != "")


def jm(tf: Column, length: Column, ctf: Column, clen: Column, lam: float = 0.1) -> Column:
    """R-03."""
    return (1 - lam) * F.coalesce(F.try_divide(tf, length), F.lit(0.0)) + lam * F.coalesce(F.try_divide(ctf, clen), F.lit(0.0))


def dirichlet(tf: Column, length: Column, ctf: Column, clen: Column, mu: Column) -> Column:
    """R-04: 0 where mu is 0."""
    return F.when(mu == 0, F.lit(0.0)).otherwise(F.try_divide(tf + mu * F.coalesce(F.try_divide(ctf, clen), F.lit(0.0)), length + mu))


def query_terms(queries: DataFrame, analyse: bool = True, stop: list[str] | None = None) -> DataFrame:
    """q_id, term, qtf and q_len (all term occurrences): analysed terms, or whitespace ones."""
    terms = analysed(F.col("q_content"), stop) if analyse else words(F.col("q_content"))
    listed = queries.select("q_id", F.size(terms).alias("q_len"), F.explode(terms).alias("term"))
    return listed.groupBy("q_id", "term", "q_len").agg(F.count(F.lit(1)).alias("qtf"))


def _weights(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "field string, weight double")


def _background(index: Index, terms: DataFrame, weights: DataFrame, lam: float) -> DataFrame:
    """q_id, term, qtf, q_len, field, weight, ctf, clen and pc, the term's weighted share of the collection.

    Terms that no weighted field has are gone: they are skipped in every score.
    """
    used = terms.join(index.terms, "term").join(weights, "field").join(index.fields.select("field", "clen", "avg_len"), "field")
    used = shared_table(terms.sparkSession, used, "query-terms")  # read by every part of a score
    total = used.groupBy("q_id", "term").agg(F.sum(F.col("weight") * F.col("ctf") / F.col("clen")).alias("pc"))
    return used.join(total, ["q_id", "term"])


def weighted_postings(index: Index, back: DataFrame) -> DataFrame:
    """doc_id, term and share (weight times tf over length, added up over the fields) of the terms and fields of _background() alone."""
    some = back.select("field", "term", "weight").distinct()
    hits = index.postings.join(small(some, F.length("term") + 64), ["field", "term"]).join(index.lengths, ["doc_id", "field"])
    return shared_table(back.sparkSession, hits.groupBy("doc_id", "term").agg(F.sum(F.col("weight") * F.col("tf") / F.col("len")).alias("share")), "weighted-postings")


def score_mixture(index: Index, queries: DataFrame, weights: dict[str, float], lam: float = 0.1, form: str = "likelihood", analyse: bool = True, within: DataFrame | None = None) -> DataFrame:
    """R-05, R-06, R-10, R-11, R-14, R-19: q_id, doc_id and score of documents with a term of the query.

    form likelihood: sum of ln p over occurrences; probability: its exp (R-10); nllr: exp of the normalised ratio;
    log1p: sum of ln(1 + p) over terms. p = sum over fields of weight times the
    Jelinek-Mercer estimate. within: q_id and doc_id that alone are scored; postings of
    others are left before anything is summed. Documents without any term have the background score only,
    which background_scores gives.
    """
    spark = queries.sparkSession
    back = _background(index, query_terms(queries, analyse), _weights(spark, weights), lam)
    seen = back.join(index.postings, ["field", "term"])
    if within is not None:
        seen = seen.join(within, ["q_id", "doc_id"], "left_semi")
    seen = seen.join(index.lengths, ["doc_id", "field"])
    p = seen.groupBy("q_id", "doc_id", "term", "qtf", "q_len", "pc").agg(F.sum((1 - lam) * F.col("weight") * F.col("tf") / F.col("len")).alias("own"))
    share = F.col("own") + lam * F.col("pc")
    gain = {"likelihood": F.col("qtf") * (F.ln(share) - F.ln(lam * F.col("pc"))), "probability": F.col("qtf") * (F.ln(share) - F.ln(lam * F.col("pc"))), "nllr": F.col("qtf") / F.col("q_len") * (F.ln(share) - F.ln(lam * F.col("pc"))), "log1p": F.log1p(share) - F.log1p(lam * F.col("pc"))}[form]
    gained = p.groupBy("q_id", "doc_id").agg(F.sum(gain).alias("gain"))
    scored = gained.join(background_scores(back, lam, form), "q_id")
    total = F.col("gain") + F.col("base")
    return scored.select("q_id", "doc_id", (F.exp(total) if form in ("nllr", "probability") else total).alias("score"))


def background_scores(back: DataFrame, lam: float, form: str) -> DataFrame:
    """q_id and base: the score of a document that has none of the terms, before exp for nllr."""
    one = back.select("q_id", "term", "qtf", "q_len", "pc").distinct()
    value = {"likelihood": F.col("qtf") * F.ln(lam * F.col("pc")), "probability": F.col("qtf") * F.ln(lam * F.col("pc")), "nllr": F.col("qtf") / F.col("q_len") * F.lit(lam).cast("double"), "log1p": F.log1p(lam * F.col("pc"))}[form]
    if form == "nllr":
        value = F.col("qtf") / F.col("q_len") * F.ln(F.lit(lam))
    return one.groupBy("q_id").agg(F.sum(value).alias("base"))


def score_dirichlet(index: Index, queries: DataFrame, field: str = "contents", mu: float | None = None) -> DataFrame:
    """R-04, R-05 with Dirichlet smoothing on one field; mu is the field's average length by default."""
    back = _background(index, query_terms(queries), _weights(queries.sparkSession, {field: 1.0}), 1.0)
    back = back.withColumn("mu", F.lit(mu).cast("double") if mu is not None else F.col("avg_len"))
    base = back.groupBy("q_id").agg(F.sum(F.col("qtf") * F.ln(F.col("mu") * F.col("pc"))).alias("base"), F.sum("qtf").alias("n"), F.max("mu").alias("mu"))
    seen = back.join(index.postings, ["field", "term"])
    gain = F.col("qtf") * (F.ln(F.col("tf") + F.col("mu") * F.col("pc")) - F.ln(F.col("mu") * F.col("pc")))
    gained = seen.groupBy("q_id", "doc_id").agg(F.sum(gain).alias("gain")).join(base, "q_id")
    gained = gained.join(index.lengths.where(F.col("field") == field).select("doc_id", "len"), "doc_id")
    return gained.select("q_id", "doc_id", (F.col("gain") + F.col("base") - F.col("n") * F.ln(F.col("len") + F.col("mu"))).alias("score"))


def mapping_probabilities(index: Index, terms: DataFrame) -> DataFrame:
    """R-07: q_id, term, qtf, field and pf, the probability of a field for a term: its share there times the field's share of documents."""
    known = terms.join(index.terms, "term").join(index.fields.select("field", "clen", "docs"), "field").where("clen > 0")
    total_docs = index.fields.agg(F.sum("docs").alias("all_docs"))
    raw = known.crossJoin(F.broadcast(total_docs)).withColumn("raw", F.col("ctf") / F.col("clen") * F.col("docs") / F.col("all_docs"))  # one row
    total = raw.groupBy("q_id", "term").agg(F.sum("raw").alias("total"))
    return raw.join(total, ["q_id", "term"]).select("q_id", "term", "qtf", "field", "ctf", "clen", (F.col("raw") / F.col("total")).alias("pf"))


def score_prms(index: Index, queries: DataFrame, lam: float = 0.1) -> DataFrame:
    """R-08: a mixture whose weights are each term's own mapping probabilities; terms without any are skipped."""
    mapped = mapping_probabilities(index, query_terms(queries))
    back = mapped.groupBy("q_id", "term", "qtf").agg(F.sum(F.col("pf") * F.col("ctf") / F.col("clen")).alias("pc"))
    seen = mapped.join(index.postings, ["field", "term"]).join(index.lengths, ["doc_id", "field"])
    own = seen.groupBy("q_id", "doc_id", "term").agg(F.sum((1 - lam) * F.col("pf") * F.col("tf") / F.col("len")).alias("own")).join(back, ["q_id", "term"])
    gained = own.groupBy("q_id", "doc_id").agg(F.sum(F.col("qtf") * (F.ln(F.col("own") + lam * F.col("pc")) - F.ln(lam * F.col("pc")))).alias("gain"))
    base = back.groupBy("q_id").agg(F.sum(F.col("qtf") * F.ln(lam * F.col("pc"))).alias("base"))
    return gained.join(base, "q_id").select("q_id", "doc_id", (F.col("gain") + F.col("base")).alias("score"))


def score_tfidf(index: Index, queries: DataFrame, n_docs: int, field: str = "contents") -> DataFrame:
    """R-01: coordination times the sum of sqrt(tf) * idf**2 / sqrt(length); any term matches."""
    terms = query_terms(queries)
    asked = terms.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_terms"))
    idf = 1 + F.ln(F.lit(float(n_docs)) / (F.col("df") + 1))
    hits = terms.join(index.terms.where(F.col("field") == field), "term").join(index.postings.where(F.col("field") == field).drop("field"), "term")
    hits = hits.join(index.lengths.where(F.col("field") == field).select("doc_id", "len"), "doc_id")
    weight = F.col("qtf") * F.sqrt("tf") * idf * idf / F.sqrt("len")
    got = hits.groupBy("q_id", "doc_id").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("matched")).join(asked, "q_id")
    return got.select("q_id", "doc_id", (F.col("matched") / F.col("n_terms") * F.col("w")).alias("score"))


def scorer(model: str):
    """R-09."""
    models = {"lm": lambda i, q, field="contents", **o: score_mixture(i, q, {field: 1.0}, **o), "mlm": score_mixture, "prms": score_prms, "dirichlet": score_dirichlet, "tfidf": score_tfidf}
    if model not in models:
        raise ValueError(f"unknown model {model}")
    return models[model]


def two_pass(index: Index, queries: DataFrame, n_docs: int, weights: dict[str, float], first: int = 10_000, keep: int = 100, lam: float = 0.1) -> DataFrame:
    """R-02: the best ``first`` by tf-idf, scored again by the mixture; the best ``keep`` with their ranks."""
    from quillspark.operators.ranking import best_of

    some = best_of(score_tfidf(index, queries, n_docs).withColumn("score", rounded("score", 6)), first).select("q_id", "doc_id")
    some = shared_table(queries.sparkSession, some, "first-pass")
    return best_of(score_mixture(index, queries, weights, lam, within=some).withColumn("score", rounded("score", 6)), keep)


def context(content: Column, mention: Column) -> Column:
    """R-12: the query without the first place that has the mention's characters; raises if there is none."""
    at = F.instr(content, mention)
    without = F.concat(F.substring(content, F.lit(1), at - 1), F.substring(content, at + F.length(mention), F.length(content)))
    return F.when(at > 0, F.trim(F.regexp_replace(without, " +", " "))).otherwise(F.raise_error(F.concat(F.lit("no such mention: "), mention)).cast("string"))


def documents_with(index: Index, terms: list[str], field: str = "contents", every: bool = True) -> DataFrame:
    """R-16: documents that have all of the terms (AND), or any (OR)."""
    hits = index.postings.where((F.col("field") == field) & F.col("term").isin(terms)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(set(terms))).select("doc_id") if every else hits.select("doc_id")


def documents_with_phrase(values: DataFrame, phrase: str, field: str = "contents") -> DataFrame:
    """R-16: documents whose analysed field has the phrase's terms in a row."""
    joined = F.concat(F.lit(" "), F.array_join(analysed(F.col("value"), []), " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.array_join(analysed(F.lit(phrase), []), " "), F.lit(" "))
    return values.where((F.col("field") == field) & F.contains(joined, wanted)).select("doc_id").distinct()


def score_entity_sets(index: Index, queries: DataFrame, members: DataFrame, weights: dict[str, float], lam: float = 0.1) -> DataFrame:
    """R-13: q_id, set_id, score of sets (q_id, set_id, doc_id): the ratio of R-11 with members' estimates added up; 0 without known terms."""
    back = _background(index, query_terms(queries, analyse=False), _weights(queries.sparkSession, weights), lam)
    sizes = members.groupBy("q_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.join(back.select("q_id", "term", "qtf", "q_len", "pc").distinct(), "q_id")
    seen = members.join(back, "q_id").join(index.postings, ["field", "term", "doc_id"]).join(index.lengths, ["doc_id", "field"])
    own = seen.groupBy("q_id", "set_id", "term").agg(F.sum((1 - lam) * F.col("weight") * F.col("tf") / F.col("len")).alias("own"))
    share = F.coalesce("own", F.lit(0.0)) + F.col("n") * lam * F.col("pc")
    scored = asked.join(own, ["q_id", "set_id", "term"], "left").groupBy("q_id", "set_id").agg(F.exp(F.sum(F.col("qtf") / F.col("q_len") * (F.ln(share) - F.ln("pc")))).alias("score"))
    return sizes.select("q_id", "set_id").join(scored, ["q_id", "set_id"], "left").na.fill(0.0, ["score"])


def context_similarity(index: Index, pairs: DataFrame, lam: float = 0.1) -> DataFrame:
    """R-12: pairs (q_id, q_content, mention, doc_id) with context_sim: R-11 of the query without its mention, on contents; 0 if unknown."""
    texts = pairs.select("q_id", "mention", context(F.col("q_content"), F.col("mention")).alias("q_content")).distinct()
    texts = texts.select(F.struct("q_id", "mention").alias("q_id"), "q_content")
    back = shared_table(pairs.sparkSession, _background(index, query_terms(texts, analyse=False), _weights(pairs.sparkSession, {"contents": 1.0}), lam), "contexts")
    base = background_scores(back, lam, "nllr")
    asked = pairs.select(F.struct("q_id", "mention").alias("q_id"), "doc_id").distinct()
    held = weighted_postings(index, back)
    seen = asked.join(back, "q_id").join(small(held, F.length("term") + 64), ["doc_id", "term"])
    gain = F.col("qtf") / F.col("q_len") * (F.ln((1 - lam) * F.col("share") + lam * F.col("pc")) - F.ln(lam * F.col("pc")))
    gained = seen.groupBy("q_id", "doc_id").agg(F.sum(gain).alias("gain"))
    scored = asked.join(base, "q_id", "left").join(gained, ["q_id", "doc_id"], "left")
    sim = F.when(F.col("base").isNull(), 0.0).otherwise(F.exp(F.col("base") + F.coalesce("gain", F.lit(0.0))))
    return scored.select("q_id.q_id", "q_id.mention", "doc_id", sim.alias("context_sim"))


def context_similarity_of_matches(index: Index, queries: DataFrame, lam: float = 0.1) -> DataFrame:
    """R-12: context_similarity() of queries (q_id, q_content, mention) and all documents whose contents have a term of theirs.

    Postings are dealt by document; a document's pairs are made, summed up and left in its task, so that no pair is shuffled.
    """
    spark = queries.sparkSession
    ids = shared_table(spark, queries.select("q_id", "mention", "q_content").distinct().withColumn("_no", F.monotonically_increasing_id()), "contexts")
    texts = ids.select(F.col("_no").alias("q_id"), context(F.col("q_content"), F.col("mention")).alias("q_content"))
    back = _background(index, query_terms(texts, analyse=False), _weights(spark, {"contents": 1.0}), lam)
    base = background_scores(back, lam, "nllr")
    asked = query_terms(ids.select(F.col("_no").alias("q_id"), "q_content")).select("q_id", "term", F.lit(True).alias("asked"))
    terms = shared_table(spark, asked.join(back.select("q_id", "term", "qtf", "q_len", "pc"), ["q_id", "term"], "full"), "asked-terms")
    contents = F.col("field") == "contents"
    met = terms.join(index.terms.where(contents), "term").agg(F.sum("df")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met // 1_000_000)
    hits = index.postings.where(contents).join(small(terms.select("term").distinct(), F.length("term") + 64), "term", "left_semi")
    hits = hits.select("doc_id", "term", "tf").repartition(n, "doc_id").join(index.lengths.where(contents).select("doc_id", "len"), "doc_id")
    hits = hits.join(small(terms, F.length("term") + 112), "term")
    gain = F.col("qtf") / F.col("q_len") * (F.ln((1 - lam) * F.col("tf") / F.col("len") + lam * F.col("pc")) - F.ln(lam * F.col("pc")))
    pairs = hits.groupBy("q_id", "doc_id").agg(F.sum(gain).alias("gain"), F.max("asked").alias("asked")).where("asked").withColumnRenamed("q_id", "_no")
    known = ids.join(base.withColumnRenamed("q_id", "_no"), "_no", "left").select("_no", "q_id", "mention", "base")
    sim = F.when(F.col("base").isNull(), 0.0).otherwise(F.exp(F.col("base") + F.coalesce("gain", F.lit(0.0))))
    return pairs.join(small(known, F.length("mention") + 96), "_no").select("q_id", "mention", "doc_id", sim.alias("context_sim"))


def context_terms(queries: DataFrame) -> DataFrame:
    """term: those of queries (q_content, mention) and of their contexts, which context_similarity_of_matches looks up."""
    context_words = words(context(F.col("q_content"), F.col("mention")))
    return queries.select(F.explode(F.concat(analysed(F.col("q_content")), context_words)).alias("term")).distinct()


def document_numbers(index: Index) -> DataFrame:
    """R-17: number (from 0, in the order of the ids) and doc_id of every document of the index."""
    from quillspark.sources.sinks import add_qids

    return add_qids(index.lengths.select("doc_id").distinct(), "doc_id").select((F.col("qid") - 1).alias("number"), "doc_id")


def document_terms(index: Index, ids: DataFrame | None = None) -> DataFrame:
    """R-17: doc_id, field and terms (array of term, tf by term) of the documents of ids (doc_id), or of all."""
    some = index.postings if ids is None else index.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return some.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))


def retrieve(spark, config) -> DataFrame:
    """S-17, R-02, R-09: the run of a RetrievalConfig: a first pass by tf-idf, its documents scored by the model, the best with their ranks."""
    from quillspark.operators.ranking import best_of
    from quillspark.sources.tables import read_json_queries

    index, queries = Index.read(spark, config.index_dir), read_json_queries(spark, config.query_file)
    n_docs = index.lengths.select("doc_id").distinct().count()
    first = best_of(score_tfidf(index, queries, n_docs, config.first_pass_field), config.first_pass_num_docs).select("q_id", "doc_id")
    if config.model == "tfidf":
        return best_of(score_tfidf(index, queries, n_docs, config.first_pass_field), config.num_docs)
    first = shared_table(spark, first, "first-pass")
    if config.model in ("lm", "mlm") and config.smoothing_method == "jm":
        weights = {config.field: 1.0} if config.model == "lm" else config.field_weights
        scored = score_mixture(index, queries, weights, config.smoothing_param, within=first)
    elif config.model == "lm" and config.smoothing_method == "dirichlet":
        scored = score_dirichlet(index, queries, config.field, config.smoothing_param if config.smoothing_param > 1 else None).join(first, ["q_id", "doc_id"], "left_semi")
    elif config.model == "prms":
        scored = score_prms(index, queries, config.smoothing_param).join(first, ["q_id", "doc_id"], "left_semi")
    else:
        raise ValueError(f"no model {config.model} with {config.smoothing_method} smoothing")
    return best_of(scored, config.num_docs)
