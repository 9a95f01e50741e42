"""Registered queries over the vector index, the embedding stage, the keyed store and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import embed, ivf
from ..operators.retrieval import vector_topk
from ..sources.readers import read_table
from ..sources.store import KeyedStore
from ..streaming import ingest as stream
from .queries import ALL_SCORES, HITS, K, _asked, _vectors, query
from .records import _folder

LISTS = 16


def _index(spark, d) -> str:
    path = _folder(spark)
    ivf.build_index(_vectors(spark, d).drop("label"), path, LISTS)
    return path


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, rank FROM h")
def ivf_topk_all_lists(spark, d):
    """Searching all lists of the inverted file is the full search."""
    return ivf.search(_asked(spark, d), _index(spark, d), K, LISTS, skip_self=True).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HITS} SELECT count(*) AS expected, true AS enough FROM h")
def ivf_recall(spark, d):
    """As many lists as a sample of rows asks for find at least 95 of 100 true neighbours of the query set."""
    path, asked = _index(spark, d), _asked(spark, d)
    probes = ivf.probes_for(_vectors(spark, d), path, K, recall=0.98)
    got = ivf.recall_against(ivf.search(asked, path, K, probes, skip_self=True), vector_topk(asked, _vectors(spark, d), K, skip_self=True))
    return got.select("expected", (F.col("recall") >= 0.95).alias("enough"))


@query(f"""WITH {ALL_SCORES}, o AS (SELECT q.query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.qe::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM q JOIN embeddings e ON true)
SELECT query_id, 'v' || chunk_id AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'v' || chunk_id) AS rank FROM o) WHERE rank <= {K}""")
def vector_topk_text_ids(spark, d):
    """Ids of any kind; a query that is no row of the corpus may find a row with its own number."""
    corpus = _vectors(spark, d).withColumn("chunk_id", F.concat(F.lit("v"), F.col("chunk_id")))
    return vector_topk(_asked(spark, d), corpus, K).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ALL_SCORES} SELECT query_id + 9007199254740993 AS query_id, chunk_id + 9007199254740993 AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {K}""")
def vector_topk_large_ids(spark, d):
    big = 9007199254740993
    corpus = _vectors(spark, d).withColumn("chunk_id", F.col("chunk_id") + big)
    asked = _asked(spark, d).withColumn("query_id", F.col("query_id") + big)
    return vector_topk(asked, corpus, K, skip_self=True).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _measures():
    """Stands for a model: characters and spaces; a text whose length is a multiple of 7 is refused."""

    def model(texts: list[str]) -> list[list[float]]:
        if any(len(t) % 7 == 0 for t in texts):
            raise embed.Rejected("length")
        return [[len(t) / 2, float(t.count(" "))] for t in texts]

    return model


EMBEDDED = "(length(text) / 2.0)::DOUBLE AS e0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS e1"


@query(f"""SELECT doc_id, CASE WHEN refused THEN NULL ELSE e0 END AS e0, CASE WHEN refused THEN NULL ELSE e1 END AS e1, refused FROM (SELECT doc_id, {EMBEDDED}, length(text) % 7 = 0 AS refused FROM documents)""")
def embed_documents(spark, d):
    """The embedding stage over all texts: a refused text costs its batch nothing."""
    rows = embed.embed(read_table(spark, d, "documents").select("doc_id", "text"), "text", _measures, "measures")
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"), F.col("error").isNotNull().alias("refused"))


@query(f"SELECT doc_id, {EMBEDDED} FROM documents WHERE length(text) % 7 <> 0")
def embed_ingest_resumed(spark, d):
    """Half of the rows first, then all of them twice: each is embedded and stored once."""
    path, docs = _folder(spark), read_table(spark, d, "documents").select("doc_id", "text")
    for part in (docs.where("doc_id % 2 = 0"), docs, docs):
        embed.ingest(part, "doc_id", "text", _measures, path, "measures")
    saved = embed.stored(spark, f"{path}/saved")
    return saved.select("doc_id", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1 - doc_id, 'added', n_chars FROM documents WHERE doc_id % 4 = 0")
def keyed_store(spark, d):
    """Upserts, new keys and deletes, each a snapshot of its own; the last one read again by another reader."""
    path, docs = _folder(spark), read_table(spark, d, "documents").select("doc_id", "source", "n_chars")
    store = KeyedStore(spark, path, ["doc_id"], "doc_id long, source string, n_chars long", buckets=8)
    store.upsert(docs)
    store.upsert(docs.where("doc_id % 3 = 0").withColumns({"source": F.lit("new"), "n_chars": F.col("n_chars") + 1}))
    store.delete(docs.where("doc_id % 5 = 0").select("doc_id"))
    store.upsert(docs.where("doc_id % 4 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("added").alias("source"), "n_chars"))
    return KeyedStore(spark, path, ["doc_id"], store.schema, buckets=8).read()


@query("SELECT doc_id, n_chars FROM documents")
def stream_ingest(spark, d):
    """Files as micro-batches; the last batch is lost before its commit and comes again."""
    path, docs = _folder(spark), read_table(spark, d, "documents").select("doc_id", "text", "n_chars")
    files = 4 * -(-docs.rdd.getNumPartitions() // 4)  # four batches, of as many files as the input has parts
    docs.repartition(files, "doc_id").write.json(f"{path}/in")
    source = lambda: stream.stream_files(spark, f"{path}/in", "doc_id long, text string, n_chars long", files_a_batch=files // 4)
    sink, tried = stream.batch_sink(f"{path}/out"), []

    def dies_once(batch, number):
        sink(batch, number)
        tried.append(number)
        if tried.count(2) == 1 and number == 2:
            raise RuntimeError(f"lost after the write of batch 2, {uuid.uuid4().hex}")

    try:
        stream.run_available(source(), f"{path}/out", f"{path}/checkpoint", sink=dies_once)
    except Exception as e:
        if "lost after the write" not in str(e):
            raise
    stream.run_available(source(), f"{path}/out", f"{path}/checkpoint", sink=dies_once)
    return stream.read_ingested(spark, f"{path}/out").select("doc_id", "n_chars")
