"""Registered queries: tokens and model inputs, embeddings and search, n-best reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as AR
from ..functions.vectors import l2_distance_exact, micro_units, round_vector
from ..operators import embed as E
from ..operators.articles import drop_empty_articles
from ..operators import hypotheses as H
from ..operators import search as SR
from ..operators import stories as ST
from ..operators import tokens as TK
from ..session import read_table
from ..sources import derived as D
from . import search as P

VEC_SUM = "vec_sum"
CHECKSUM_BYTES = 4 << 20  # vectors folded at once
WINDOWS = 1_000_000  # a window's key: article id times this plus the window's number


def _vocab(spark, sf_dir, source="documents") -> TK.Vocabulary:
    return D.corpus_vocabulary(spark, sf_dir, source)


def _doc_tokens(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", TK.whitespace_tokens(F.col("text")).alias("words"))


def _sum_array(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


# --- tokens and model inputs --------------------------------------------------------------

def truncate_tokens(spark, sf_dir):
    t = _doc_tokens(spark, sf_dir)
    return t.select("doc_id", F.array_join(AR.truncate_tokens(F.col("words"), 128), " ").alias("tokens"))


def add_special_tokens(spark, sf_dir):
    t = _doc_tokens(spark, sf_dir)
    return t.select("doc_id", F.array_join(AR.add_special_tokens(F.col("words")), " ").alias("tokens"))


def model_input_rows(spark, sf_dir):
    rows = TK.model_input_rows(_doc_tokens(spark, sf_dir), _vocab(spark, sf_dir), "words", 128)
    return rows.select("doc_id", F.array_join("input_ids", ",").alias("ids"),
                       _sum_array(F.col("input_mask")).cast("int").alias("mask_sum"),
                       _sum_array(F.col("input_type_ids")).cast("int").alias("type_sum"))


def _token_ids_long(spark, sf_dir, max_entries=TK.MAX_VOCAB_ENTRIES):
    vocab = _vocab(spark, sf_dir, "benchmark")  # a smaller vocabulary: unknown words occur
    vocab.max_entries = max_entries
    long = _doc_tokens(spark, sf_dir).select("doc_id", F.posexplode("words").alias("pos", "token"))
    return TK.token_ids_long(long, vocab), vocab


def token_to_id_shuffled(spark, sf_dir):
    """``token_to_id`` with a vocabulary that may not be broadcast: a count finds the frequent
    words, whose rows stay where they are; the others are shuffled."""
    return token_to_id(spark, sf_dir, max_entries=0)


def token_to_id(spark, sf_dir, max_entries=TK.MAX_VOCAB_ENTRIES):
    ided, vocab = _token_ids_long(spark, sf_dir, max_entries)
    unk = vocab.id_of(AR.UNK)
    return ided.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.when(F.col("id") == unk, 1).otherwise(0)).cast("long").alias("n_unknown"),
        F.sum("id").cast("long").alias("id_sum"),
        F.sum((F.col("pos") + 1) * F.col("id")).cast("long").alias("id_place_sum"))


def id_to_token(spark, sf_dir):
    ided, vocab = _token_ids_long(spark, sf_dir)
    back = TK.id_tokens_long(ided.select("doc_id", "pos", "id"), vocab)
    # one group per document, bounded by the document's length
    grouped = back.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return grouped.select("doc_id", F.md5(F.array_join(F.col("t.token"), " ")).alias("text_md5"))


def truncate_pair(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.size(TK.whitespace_tokens(F.col("text")))
    p = c.select("conv_id", "turn", n.alias("la"), F.lead(n).over(w).alias("lb")).filter(F.col("lb").isNotNull())
    ka, kb = AR.truncate_pair_lengths(F.col("la"), F.col("lb"), 64)
    return p.select("conv_id", "turn", ka.alias("ka"), kb.alias("kb"))


def _collated(spark, sf_dir):
    stories = ST.process_story(D.raw_stories(spark, sf_dir))
    vocab = _vocab(spark, sf_dir)
    return TK.collate_rows(stories, vocab, 512, "conv_id"), vocab


def encode_story(spark, sf_dir):
    stories = ST.process_story(D.raw_stories(spark, sf_dir))
    pre = stories.select("conv_id", TK.encode_lines(F.col("story_lines")).alias("toks"))
    ided = TK.tokens_to_ids(pre, _vocab(spark, sf_dir), "toks", "ids")
    return ided.select("conv_id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def collate_rows(spark, sf_dir):
    c, _ = _collated(spark, sf_dir)
    return c.select("conv_id", F.md5(F.array_join("src", ",")).alias("src_md5"),
                    F.array_join("segs", "").alias("segs"), _sum_array(F.col("mask_src")).cast("int").alias("mask_sum"),
                    "tgt_str")


def _encoded(spark, sf_dir):
    """Ids of whole stories (no block cut) and the vocabulary."""
    stories = ST.process_story(D.raw_stories(spark, sf_dir))
    vocab = _vocab(spark, sf_dir)
    pre = stories.select("conv_id", TK.encode_lines(F.col("story_lines")).alias("toks")).filter(F.size("toks") > 0)
    return TK.tokens_to_ids(pre, vocab, "toks", "ids").select("conv_id", "ids"), vocab


def segment_ids(spark, sf_dir):
    e, vocab = _encoded(spark, sf_dir)
    return e.select("conv_id", F.array_join(AR.segment_ids(F.col("ids"), vocab.id_of(AR.CLS)), "").alias("segs"))


def segment_ids_long(spark, sf_dir):
    """The same segments by a prefix sum over the long table of all stories' ids."""
    e, vocab = _encoded(spark, sf_dir)
    long = e.select("conv_id", F.posexplode("ids").alias("pos", "id"))
    segs = TK.segment_ids_long(long, "conv_id", "pos", "id", vocab.id_of(AR.CLS))
    # one string per story, bounded by its length
    rows = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seg"))).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["seg"]), "").alias("segs"))


def truncate_or_pad(spark, sf_dir):
    c, _ = _collated(spark, sf_dir)
    return c.select("conv_id", F.array_join("src", ",").alias("src"))


def build_mask(spark, sf_dir):
    """Mask of whole stories, each followed by one pad id."""
    e, vocab = _encoded(spark, sf_dir)
    pad = vocab.id_of(AR.PAD)
    padded = F.concat(F.col("ids"), F.array(F.lit(pad)))
    return e.select("conv_id", F.array_join(AR.build_mask(padded, pad), "").alias("mask"))


def source_excerpt(spark, sf_dir):
    c, vocab = _collated(spark, sf_dir)
    toks = TK.ids_to_tokens(c.select("conv_id", "src"), vocab, "src", "src_tokens")
    return toks.select("conv_id", AR.source_excerpt(F.col("src_tokens"), 500).alias("excerpt"))


def wordpiece_tokenize(spark, sf_dir):
    d = read_table(spark, sf_dir, "benchmark")
    vocab = D.wordpiece_vocabulary(spark, sf_dir)
    pieces = TK.wordpiece_tokenize(d.select("item_id", "text"), vocab, "text", "pieces")
    return pieces.select("item_id", F.size("pieces").alias("n_pieces"), F.array_join("pieces", " ").alias("pieces"))


# --- embeddings and search --------------------------------------------------------------

def _vec_sum(vec):
    return _sum_array(micro_units(vec))


def _checksum_fold(key: str):
    """``(fold, schema)`` of ``_vector_checksum``: batches of (key, vectors) to its rows, a bounded slice
    of the vectors at a time (their micro-units take several times their own room)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(batches):
        for rb in (part for big in batches if big.num_rows for part in E.row_slices(big, big.nbytes / big.num_rows, CHECKSUM_BYTES)):
            counts = pc.fill_null(pc.list_value_length(rb.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = rb.column(1).flatten()
            flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            micro = np.copysign(np.floor(np.abs(flat) * 1e6 + 0.5), flat).astype(np.int64)
            out = np.zeros(len(counts), np.int64)
            if len(inner):
                per = micro.reshape(len(inner), -1).sum(axis=1)
                row = np.repeat(np.arange(len(counts)), counts)
                pos = np.arange(len(inner)) - np.repeat(np.cumsum(counts) - counts, counts)
                np.add.at(out, row, (pos + 1) * per)
            yield pa.record_batch([rb.column(0), pa.array(counts.astype(np.int32)), pa.array(out)], [key, "n_tokens", VEC_SUM])

    return sums, f"{key} long, n_tokens int, {VEC_SUM} long"


def _sums_fold(batches):
    """Batches of vectors by token with the sum of their components in micro-units instead, a bounded
    slice of the vectors at a time."""
    import numpy as np
    import pyarrow as pa

    for rb in (part for big in batches if big.num_rows for part in E.row_slices(big, big.nbytes / big.num_rows, CHECKSUM_BYTES)):
        counts = rb.column(3).to_numpy().astype(np.int64)  # every group has a vector
        flat = rb.column(4).flatten().flatten().to_numpy(zero_copy_only=False) * 1e6
        whole = np.floor(np.abs(flat) + 0.5)
        each = np.copysign(whole, flat, out=whole).astype(np.int64).reshape(int(counts.sum()), -1).sum(axis=1)
        sums = np.add.reduceat(each, np.cumsum(counts) - counts)
        yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array(sums)], names=[*rb.schema.names[:4], VEC_SUM])


def _flat_fold(batches):
    """Batches of (key, map of vectors by token) as (key, all vectors)."""
    import pyarrow as pa

    for rb in batches:
        yield pa.RecordBatch.from_arrays([rb.column(0), E.flatten_vectors(rb.column(1))], names=[rb.schema.names[0], "v"])


def _vector_checksum(df: DataFrame | E.InTask, key: str, vecs_col: str) -> DataFrame:
    """``(key, n_tokens, vec_sum)``: token count and the sum over positions of (position + 1)
    times the vector's components in micro-units, so the order of vectors counts."""
    if isinstance(df, E.InTask):  # (key, vectors)
        return df.then(*_checksum_fold(key)).rows()
    return df.select(F.col(key).cast("long").alias(key), vecs_col).mapInArrow(*_checksum_fold(key))


def _by_token(spark, sf_dir):
    """Each article's vectors by token. Texts are shuffled by article; the vectors made of them stay in
    their task. A lookup table beyond the broadcast bound is joined, which loses the order."""
    enc = P.lookup_encoder(spark, sf_dir)
    texts = P.text_articles(spark, sf_dir).filter(F.col("text").isNotNull())
    if not enc.fits:
        return E.vectors_by_token(E.token_vectors_long(P.embed_texts(texts, enc, "article_id"), "article_id"), "article_id")
    made = P.embed_texts(E.gathered(texts, "article_id"), enc, "article_id", in_task=True)
    return E.vectors_by_token(E.token_vectors_long(made, "article_id"), "article_id", in_runs=True)


def embed_tokens(spark, sf_dir):
    """A vector for every token of every text; each task folds its vectors to their checksums."""
    enc = P.lookup_encoder(spark, sf_dir)
    texts = P.text_articles(spark, sf_dir).filter(F.col("text").isNotNull())
    if not enc.fits:
        return _vector_checksum(P.embed_texts(texts, enc, "article_id"), "article_id", "vecs")
    tokens = P.text_tokens(texts.withColumn("article_id", F.col("article_id").cast("long")), "article_id")
    return E.embed_tokens(tokens, enc, "tokens", "vecs", fold=_checksum_fold("article_id"), keep=["article_id"])


def _windowed_inputs(spark, sf_dir, arts):
    """Model input rows of whole texts, one per window, the lookup encoder, and a model over its
    table (None if the table is beyond the broadcast bound)."""
    enc = P.lookup_encoder(spark, sf_dir)
    n = enc.n_rows
    # one input row per window of the text; the windows' positions keep their order
    windows = arts.select("article_id", F.posexplode(E.word_windows(F.col("text"), P.SEQ_LENGTH)).alias("win", "w"))
    toks = windows.select("article_id", "win", AR.add_special_tokens(
        F.array_remove(F.split("w", " ", -1), "")).alias("tokens"))
    ids = toks.select("article_id", "win", AR.truncate_or_pad(E.lookup_token_ids(F.col("tokens"), n), 128, 0).alias("input_ids"),
                      AR.real_mask(F.col("tokens"), 128).alias("input_mask"), AR.zeros(128).alias("input_type_ids"))

    if not enc.fits:
        return ids, enc, None

    def make_predict_fn(W=enc.broadcast(spark)):
        table = W.value

        def predict(input_ids, input_mask, input_type_ids):
            return table[input_ids + input_type_ids]
        return predict

    return ids, enc, E.BatchEncoder(make_predict_fn, "lookup-table", batch_size=32, with_types=True)


def _real_ids(inputs, *keys):
    """``tok_ids``: the ids of the real positions of model input rows."""
    real = F.filter(F.arrays_zip("input_ids", "input_mask"), lambda z: z["input_mask"] == 1)
    return inputs.select(*keys, F.transform(real, lambda z: z["input_ids"]).alias("tok_ids"))


def search_model(spark, sf_dir):
    """The search with a model encoder: input rows, inference and scoring in one Arrow step."""
    inputs, enc, model = _windowed_inputs(spark, sf_dir, drop_empty_articles(P.text_articles(spark, sf_dir), "text"))
    queries = P.query_vectors(P.text_queries(spark, sf_dir), enc)
    if model is None:  # the table stays distributed: its rows are joined to each window's ids
        minima = SR.min_distance_long(E.token_vectors(_real_ids(inputs, "article_id"), enc, "article_id"), queries)
    else:
        minima = SR.min_distance_model(inputs, queries, model, k=P.K)
    return SR.ranked_order(SR.topk_closest(SR.mean_best_distance(minima), P.K))


def micro_batch(spark, sf_dir):
    """Same vectors through the generic batch-inference path (micro-batches of 32)."""
    arts = P.text_articles(spark, sf_dir).filter(F.col("text").isNotNull())
    ids, enc, model = _windowed_inputs(spark, sf_dir, arts)
    window = (F.col("article_id") * WINDOWS + F.col("win")).cast("long")
    if model is None:
        out = E.vectors_of_ids(_real_ids(ids, "article_id", "win"), enc, "tok_ids", "vecs")
        return _vector_checksum(out.withColumn("article_id", window), "article_id", "vecs")
    # the vectors are folded in the task that makes them
    return E.embed_model_inputs(ids.withColumn("article_id", window).drop("win"), model, fold=_checksum_fold("article_id"),
                                keep=["article_id"])


def flatten_vectors(spark, sf_dir):
    by = _by_token(spark, sf_dir)
    if isinstance(by, E.InTask):
        maps = E.token_vector_map(by, "article_id", in_runs=True)
        flat = maps.then(_flat_fold, T.StructType([maps.schema["article_id"], T.StructField("v", E.VECS_TYPE)]))
        return _vector_checksum(flat, "article_id", "v")
    m = E.token_vector_map(by, "article_id")
    flat = m.select("article_id", E.flatten_vectors(F.col("token_vectors")).alias("v"))
    return _vector_checksum(flat, "article_id", "v")


def vectors_by_token(spark, sf_dir):
    by = _by_token(spark, sf_dir)
    if isinstance(by, E.InTask):
        return by.then(_sums_fold, T.StructType([*by.schema.fields[:4], T.StructField(VEC_SUM, T.LongType())])).rows()
    return by.select("article_id", "token", "first_pos", "n_vectors", _vec_sum(F.flatten("vectors")).alias(VEC_SUM))


def first_vector_per_token(spark, sf_dir):
    q = P.query_vectors(P.text_queries(spark, sf_dir), P.lookup_encoder(spark, sf_dir))
    return q.select("query_id", "tok_no", "token", _vec_sum(F.col("vec")).alias(VEC_SUM))


def embed_query(spark, sf_dir):
    """Every token vector of a query in order, ``[CLS]`` and ``[SEP]`` included."""
    e = P.embed_texts(P.text_queries(spark, sf_dir), P.lookup_encoder(spark, sf_dir), "query_id")
    long = E.token_vectors_long(e, "query_id")
    return long.select("query_id", "pos", "token", _vec_sum(F.col("vec")).alias(VEC_SUM))


def nearest_token_distance(spark, sf_dir):
    art_long, queries = D.vector_search_inputs(spark, sf_dir)
    return SR.min_distance_per_query_token(D.articles_from_long(art_long), queries)


def min_distance_per_query_token(spark, sf_dir):
    """Long-table form: token rows are scored where they are, partial minima are combined by
    a min aggregate (no grouping of vectors by article)."""
    art_long, queries = D.vector_search_inputs(spark, sf_dir)
    return SR.min_distance_long(art_long, queries)


def _mean_best(spark, sf_dir):
    art_long, queries = D.vector_search_inputs(spark, sf_dir)
    minima = SR.min_distance_per_query_token(D.articles_from_long(art_long), queries)
    return SR.mean_best_distance(minima)


def mean_best_distance(spark, sf_dir):
    return _mean_best(spark, sf_dir).select("query_id", "article_id", F.round("distance", 6).alias("distance"))


def topk_closest(spark, sf_dir):
    """Ten closest articles per query; each batch sends on its own ten best only."""
    art_long, queries = D.vector_search_inputs(spark, sf_dir)
    return SR.ranked_order(SR.topk_closest(SR.article_query_distances(D.articles_from_long(art_long), queries, k=10), 10))


def ranked_order(spark, sf_dir):
    """Ranks over the averaged minima of a whole (query, article) table."""
    return SR.ranked_order(SR.topk_closest(_mean_best(spark, sf_dir), P.K))


def selected_articles(spark, sf_dir):
    top = P.search_articles(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source")
    return SR.selected_articles(docs, top).select("query_id", "rank", "article_id", "source")


def l2_distance(spark, sf_dir):
    """Distance of each vector to the one with the next id (an equi-join on the id)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("next_vec"))
    p = e.join(after, "vec_id")
    return p.select("vec_id", "next_id", l2_distance_exact(F.col("embedding"), F.col("next_vec")).alias("distance"))


def round_vector_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(round_vector(F.col("embedding"))).alias("i", "value"))


# --- n-best reranking ---------------------------------------------------------------------

def _cands(spark, sf_dir):
    return D.nbest_candidates(spark, sf_dir)


def _scored(spark, sf_dir):
    return H.block_repeated_trigram(H.candidate_score(H.suppress_early_end(_cands(spark, sf_dir))))


def suppress_early_end(spark, sf_dir):
    return H.suppress_early_end(_cands(spark, sf_dir)).select("doc_id", "beam", "cand", "token_logprob")


def length_penalty(spark, sf_dir):
    from ..functions.vectors import length_penalty as lp
    c = _cands(spark, sf_dir)
    n = F.col("step") + 1
    return c.select("doc_id", "beam", "cand", F.round(lp("wu", n, H.ALPHA), 12).alias("lp_wu"),
                    F.round(lp("avg", n, H.ALPHA), 12).alias("lp_avg"), F.round(lp("none", n, H.ALPHA), 12).alias("lp_none"))


def candidate_score(spark, sf_dir):
    s = H.candidate_score(H.suppress_early_end(_cands(spark, sf_dir)))
    return s.select("doc_id", "beam", "cand", F.col("score").cast("float").alias("score"))


def block_repeated_trigram(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "beam", "cand", "blocked")


def candidate_topk(spark, sf_dir):
    t = H.candidate_topk(_scored(spark, sf_dir))
    return t.select("doc_id", "step", F.col("cand_rank").cast("int").alias("cand_rank"), "beam", "cand",
                    F.col("score").cast("float").alias("score"))


def best_hypothesis(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("finished", F.col("token") == AR.EOS)
    b = H.best_hypothesis(s, order_cols=("step", "beam", "token_id"))
    return b.select("doc_id", "beam", "cand", F.col("score").cast("float").alias("score"),
                    H.hypothesis_text(F.concat(F.col("alive"), F.array(F.col("token")))).alias("text"))


def rerank_hypotheses(spark, sf_dir):
    r = H.rerank_hypotheses(_cands(spark, sf_dir))
    return r.select("doc_id", "beam", "cand", F.col("score").cast("float").alias("score"), "finished", "text")


def split_flat_index(spark, sf_dir):
    c = _cands(spark, sf_dir)
    beam, tok = AR.split_flat_index(F.col("flat_index"), D.FLAT_VOCAB)
    return c.select("doc_id", "beam", "cand", beam.cast("int").alias("beam_rec"), tok.cast("int").alias("token_rec"))


QUERIES = {
    "truncate_tokens": truncate_tokens,
    "add_special_tokens": add_special_tokens,
    "model_input_rows": model_input_rows,
    "token_to_id": token_to_id,
    "token_to_id_shuffled": token_to_id_shuffled,
    "id_to_token": id_to_token,
    "truncate_pair": truncate_pair,
    "encode_story": encode_story,
    "collate_rows": collate_rows,
    "segment_ids": segment_ids,
    "segment_ids_long": segment_ids_long,
    "truncate_or_pad": truncate_or_pad,
    "build_mask": build_mask,
    "source_excerpt": source_excerpt,
    "wordpiece_tokenize": wordpiece_tokenize,
    "embed_tokens": embed_tokens,
    "micro_batch": micro_batch,
    "search_model": search_model,
    "flatten_vectors": flatten_vectors,
    "vectors_by_token": vectors_by_token,
    "first_vector_per_token": first_vector_per_token,
    "embed_query": embed_query,
    "nearest_token_distance": nearest_token_distance,
    "min_distance_per_query_token": min_distance_per_query_token,
    "mean_best_distance": mean_best_distance,
    "topk_closest": topk_closest,
    "ranked_order": ranked_order,
    "selected_articles": selected_articles,
    "l2_distance": l2_distance,
    "round_vector": round_vector_rows,
    "suppress_early_end": suppress_early_end,
    "length_penalty": length_penalty,
    "candidate_score": candidate_score,
    "block_repeated_trigram": block_repeated_trigram,
    "candidate_topk": candidate_topk,
    "best_hypothesis": best_hypothesis,
    "rerank_hypotheses": rerank_hypotheses,
    "split_flat_index": split_flat_index,
}
