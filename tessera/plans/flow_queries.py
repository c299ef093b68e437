"""Registered queries: streaming top-k, article stream, summaries and the CSV sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import CLS, EOS, SEP
from ..operators import stories as ST
from ..operators.articles import drop_empty_articles
from ..operators.embed import distinct_word_tokens
from ..operators.search import written
from ..operators import summaries as SM
from ..operators import tokens as TK
from ..session import read_table, scratch_path
from ..sources import derived as D
from ..sources import files as FS
from ..streaming import topk as STR
from . import search as P


def _vector_articles(spark, sf_dir):
    art_long, queries = D.vector_search_inputs(spark, sf_dir)
    return D.articles_from_long(art_long).select("article_id", "vecs"), queries


def running_topk(spark, sf_dir):
    """Running top-10 over the vector articles arriving as three files."""
    arts, queries = _vector_articles(spark, sf_dir)
    src = scratch_path(spark, "arrivals")
    arts.repartition(3).write.parquet(src)
    return STR.stream_topk(spark, src, queries, scratch_path(spark, "state"), scratch_path(spark, "ckpt"), k=10)


def stream_topk(spark, sf_dir):
    """Running top-10 of the text search (documents x benchmark) over four arriving files."""
    enc = P.lookup_encoder(spark, sf_dir)
    arts = P.text_articles(spark, sf_dir)
    # arrivals carry token ids; the encoder runs inside the scoring task of each micro-batch
    tok_ids = (drop_empty_articles(arts, "text")
               .select("article_id", enc.token_ids(distinct_word_tokens(F.col("text"))).alias("tok_ids")))
    queries = P.query_vectors(P.text_queries(spark, sf_dir), enc)
    src = scratch_path(spark, "arrivals")
    tok_ids.repartition(4).write.parquet(src)
    if enc.fits:
        return STR.stream_topk_keyed(spark, src, queries, scratch_path(spark, "ckpt"), k=10, max_files_per_trigger=2, encoder=enc)
    return STR.stream_topk(spark, src, queries, scratch_path(spark, "state"), scratch_path(spark, "ckpt"), k=10,
                           encoder=enc)


def stream_resume(spark, sf_dir):
    """Stop after the first arrivals, restart on the same checkpoint with more files."""
    arts, queries = _vector_articles(spark, sf_dir)
    src, ckpt = scratch_path(spark, "arrivals"), scratch_path(spark, "ckpt")
    keyed = arts.withColumn("_part", F.pmod(F.xxhash64("article_id"), F.lit(3)))
    keyed.filter(F.col("_part") == 0).drop("_part").write.parquet(src)  # first arrivals
    STR.stream_topk_keyed(spark, src, queries, ckpt, k=10)
    keyed.filter(F.col("_part") != 0).drop("_part").write.mode("append").parquet(src)  # the rest, later
    return STR.stream_topk_keyed(spark, src, queries, ckpt, k=10)


def stream_articles(spark, sf_dir):
    src = D.write_article_json(spark, sf_dir, scratch_path(spark, "articles"))
    out = STR.stream_articles(spark, src, scratch_path(spark, "records"), scratch_path(spark, "ckpt"),
                              glob="*.txt", multi_line=False)
    return out.select("paper_id", "title")


def _summaries(spark, sf_dir):
    """Stories of the chosen articles -> encoded rows -> n-best (lead generator) -> best."""
    top = P.search_articles(spark, sf_dir)
    chosen = top.groupBy("article_id").agg(F.min("rank").alias("best_rank"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text", "source")
    # at most k per query: written once, so that texts and titles come from one corpus scan
    sel = written(docs.join(chosen, "article_id"), "chosen")
    stories = ST.process_story(sel.select("article_id", F.col("text").alias("raw_story")))
    vocab = D.corpus_vocabulary(spark, sf_dir)
    enc = TK.collate_rows(stories, vocab, 512, "article_id")
    gen = SM.lead_generator(vocab.id_of(CLS), vocab.id_of(SEP), vocab.id_of(EOS))
    nbest = SM.summarize(enc, gen, name="lead", key_col="article_id", batch_size=1)
    best = SM.best_summary(nbest, vocab, "article_id")
    meta = sel.select("article_id", F.col("article_id").cast("string").alias("paper_id"),
                      F.col("source").alias("title"), "best_rank")
    return SM.attach_summaries(best, meta, "article_id")


def summarize(spark, sf_dir):
    return _summaries(spark, sf_dir).select("article_id", "score", "summary")


def attach_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir).select("paper_id", "title", "summary")


def sink_summaries_csv(spark, sf_dir):
    from ..operators.ids import sequence_ids
    s = _summaries(spark, sf_dir)
    ranked = sequence_ids(s, ["best_rank", "article_id"], "rank").withColumn("rank", F.col("rank") + 1)
    path = scratch_path(spark, "summaries")
    FS.sink_summaries_csv(ranked, path, "rank")
    return FS.read_summaries_csv(spark, path)


def summarize_articles(spark, sf_dir):
    return sink_summaries_csv(spark, sf_dir)


QUERIES = {
    "running_topk": running_topk,
    "stream_topk": stream_topk,
    "stream_resume": stream_resume,
    "stream_articles": stream_articles,
    "summarize": summarize,
    "attach_summaries": attach_summaries,
    "sink_summaries_csv": sink_summaries_csv,
    "summarize_articles": summarize_articles,
}
