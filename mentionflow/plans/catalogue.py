"""Named queries over a data folder's tables, with the SQL that DuckDB runs for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.functions import vectors as vec
from mentionflow.operators import corpus, hierarchy, linking, metrics, ordered, sampling, text, training, trees
from mentionflow.operators import mentions as mention_ops
from mentionflow.sources import corpora
from mentionflow.streaming import strategies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLD = 0.30


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.col("ts").alias("date"), "event_type")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("mention"), F.col("p_brand").alias("entity_id"), F.col("p_type").alias("document_id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").alias("entity_id"), "embedding")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("seq", F.col("entity_id").alias("true_id"), F.col("mention").alias("pred_id"))


def train_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks are the training mentions, all other events the evaluated ones."""
    return df.filter("event_type = 'click'"), df.filter("event_type <> 'click'")


EV = "(SELECT event_id seq, user_id entity_id, ts date, event_type FROM events) ev"
A = "a AS (SELECT p_partkey seq, p_brand true_id, p_name pred_id FROM part)"
SIDES = f"{A}, n AS (SELECT true_id, pred_id, count(*) n FROM a GROUP BY 1, 2), t AS (SELECT true_id, sum(n) size, count(*) parts FROM n GROUP BY 1), p AS (SELECT pred_id, sum(n) size, count(*) parts FROM n GROUP BY 1)"
DENSE = "f AS (SELECT {k}, min(p_partkey) m FROM part GROUP BY {k}), i AS (SELECT *, row_number() OVER (ORDER BY m) - 1 id FROM f)"

add("entity_counts", lambda s, d: corpus.entity_counts(events(s, d)), f"SELECT entity_id, count(*) count FROM {EV} GROUP BY 1")
add("entity_vocab", lambda s, d: corpus.entity_vocab(events(s, d)), f"SELECT '[PAD]' entity, CAST(0 AS BIGINT) count, CAST(0 AS BIGINT) idx UNION ALL SELECT entity, count, row_number() OVER (ORDER BY count DESC, f) FROM (SELECT CAST(entity_id AS VARCHAR) entity, count(*) count, min(seq) f FROM {EV} GROUP BY 1)")
add("unique_entities", lambda s, d: corpus.unique_entities(parts(s, d), "mention"), "SELECT count(*) n_unique, CAST(coalesce(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) n_singleton FROM (SELECT count(*) c FROM part GROUP BY p_name)")
add("entity_spans", lambda s, d: corpus.entity_spans(events(s, d)), f"SELECT entity_id, min(seq) first_seq, max(seq) last_seq FROM {EV} GROUP BY 1")
add("max_active", lambda s, d: corpus.max_active(events(s, d)), f"WITH sp AS (SELECT min(seq) a, max(seq) + 1 b FROM {EV} GROUP BY entity_id), e AS (SELECT a x, 1 v FROM sp UNION ALL SELECT b, -1 FROM sp), g AS (SELECT x, sum(v) v FROM e GROUP BY x) SELECT CAST(max(s) AS BIGINT) max_active FROM (SELECT sum(v) OVER (ORDER BY x) s FROM g)")
for kind, seen in (("seen_split", True), ("unseen_split", False)):
    add(kind, lambda s, d, seen=seen: corpus.split_seen(train_of(events(s, d))[1], train_of(events(s, d))[0], seen=seen).select("seq", "entity_id"), f"SELECT seq, entity_id FROM {EV} WHERE event_type <> 'click' AND entity_id {'' if seen else 'NOT '}IN (SELECT user_id FROM events WHERE event_type = 'click')")
add("percent_overlap", lambda s, d: corpus.percent_overlap(train_of(events(s, d))[1], train_of(events(s, d))[0]), f"WITH t AS (SELECT DISTINCT user_id u FROM events WHERE event_type = 'click'), e AS (SELECT DISTINCT user_id u FROM events WHERE event_type <> 'click') SELECT count(e.u) n_seen, count(*) n_train, round(count(e.u) / count(*), 6) overlap FROM t LEFT JOIN e USING (u)")
add("unseen_entities", lambda s, d: corpus.unseen_entities(train_of(events(s, d))[1], train_of(events(s, d))[0]), "SELECT user_id entity_id FROM events WHERE event_type <> 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'click'")
add("topic_split", lambda s, d: read(s, d, "part").select("p_partkey", corpus.topic_split(F.col("p_size")).alias("split")), "SELECT p_partkey, CASE WHEN p_size IN (2, 5, 12, 18, 21, 23, 34, 35) THEN 'dev' WHEN p_size BETWEEN 1 AND 35 THEN 'train' ELSE 'test' END split FROM part")
add("date_split", lambda s, d: corpus.date_split(events(s, d)).select("seq", "split"), f"SELECT seq, CASE WHEN r <= n * 6 // 10 THEN 'train' WHEN r <= n * 6 // 10 + n * 2 // 10 THEN 'dev' ELSE 'test' END split FROM (SELECT seq, row_number() OVER (ORDER BY date, seq) r, count(*) OVER () n FROM {EV})")
add("dense_ids", lambda s, d: ordered.dense_ids(parts(s, d), ["entity_id"], "seq", "dense_id").select("seq", "dense_id"), f"WITH {DENSE.format(k='p_brand')} SELECT p_partkey seq, id dense_id FROM part JOIN i USING (p_brand)")
add("string_match", lambda s, d: linking.string_match(parts(s, d)), f"WITH {DENSE.format(k='p_name')} SELECT p_partkey seq, id cluster_id FROM part JOIN i USING (p_name)")
add("oracle_wd", lambda s, d: linking.oracle_within_document(parts(s, d)), f"WITH {DENSE.format(k='p_brand, p_type')} SELECT p_partkey seq, id cluster_id FROM part JOIN i USING (p_brand, p_type)")
add("oracle_wd_compat", lambda s, d: linking.oracle_within_document_compat(parts(s, d)), "WITH f AS (SELECT p_partkey seq, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1 THEN 1 ELSE 0 END n FROM part) SELECT seq, CAST(sum(n) OVER (ORDER BY seq) - n AS BIGINT) cluster_id FROM f")
add("entity_encode", lambda s, d: corpus.entity_encode(events(s, d), corpus.entity_vocab(train_of(events(s, d))[0])).select("seq", "idx"), "WITH t AS (SELECT user_id u, count(*) c, min(event_id) f FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT u, row_number() OVER (ORDER BY c DESC, f) idx FROM t), o AS (SELECT user_id u, row_number() OVER (ORDER BY min(event_id)) + (SELECT max(idx) FROM v) idx FROM events WHERE user_id NOT IN (SELECT u FROM v) GROUP BY 1) SELECT event_id seq, idx FROM events JOIN (SELECT * FROM v UNION ALL SELECT * FROM o) x ON x.u = user_id")
add("span_split_chars", lambda s, d: read(s, d, "documents").select("doc_id", *corpus.span_split_chars(F.col("text"), F.lit(3), F.lit(9))), "SELECT doc_id, substr(text, 1, 3) left_context, substr(text, 4, 6) mention, substr(text, 10) right_context FROM documents")
add("span_split_tokens", lambda s, d: read(s, d, "documents").select("doc_id", *corpus.span_split_tokens(F.col("text"), F.lit(2), F.lit(4))), "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') t FROM documents) SELECT doc_id, array_to_string(t[1:2], ' ') left_context, array_to_string(t[3:5], ' ') mention, array_to_string(t[6:], ' ') right_context FROM t")
add("json_project", lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') k FROM events")
add("sectionize", lambda s, d: corpus.sectionize(read(s, d, "conversations"), F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").select("conv_id", "turn", "section", "mention_index"), "WITH m AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) section FROM conversations) SELECT conv_id, turn, section, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) - 1 mention_index FROM m WHERE role <> 'user'")
add("contingency", lambda s, d: metrics.contingency(assigned(s, d)), f"WITH {SIDES} SELECT * FROM n")
add("muc", lambda s, d: metrics.muc(assigned(s, d)), f"WITH {SIDES}, r AS (SELECT (SELECT sum(size - parts) / (sum(size - 1) + 1e-13) FROM p) x, (SELECT sum(size - parts) / (sum(size - 1) + 1e-13) FROM t) y) SELECT round(x, 6) AS \"precision\", round(y, 6) recall, round(CASE WHEN x + y > 0 THEN 2 * x * y / (x + y) ELSE 0.0 END, 6) f1 FROM r")
add("b_cubed", lambda s, d: metrics.b_cubed(assigned(s, d)), f"WITH {SIDES}, r AS (SELECT sum(n.n * n.n / CAST(p.size AS DOUBLE)) / sum(n.n) x, sum(n.n * n.n / CAST(t.size AS DOUBLE)) / sum(n.n) y FROM n JOIN t USING (true_id) JOIN p USING (pred_id)) SELECT round(x, 6) AS \"precision\", round(y, 6) recall, round(2 * x * y / (x + y), 6) f1 FROM r")
add("phi4", lambda s, d: metrics.phi4(assigned(s, d)), f"WITH {SIDES} SELECT true_id, pred_id, round(2 * n.n / CAST(t.size + p.size AS DOUBLE), 6) phi4 FROM n JOIN t USING (true_id) JOIN p USING (pred_id)")
add("conflated_divided", lambda s, d: metrics.conflated_divided(assigned(s, d)), f"WITH {SIDES} SELECT CAST((SELECT sum(parts - 1) FROM p) AS BIGINT) conflated, CAST((SELECT sum(parts - 1) FROM t) AS BIGINT) divided")
add("most_conflated", lambda s, d: metrics.most_mixed(assigned(s, d), "pred_id", "true_id"), f"WITH {A} SELECT pred_id, count(DISTINCT true_id) parts, min(seq) first_seq, count(*) size FROM a GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1")
add("most_split", lambda s, d: metrics.most_mixed(assigned(s, d), "true_id", "pred_id"), f"WITH {A} SELECT true_id, count(DISTINCT pred_id) parts, min(seq) first_seq, count(*) size FROM a GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1")
add("median_cluster_size", lambda s, d: metrics.median_cluster_size(assigned(s, d)), "SELECT quantile_cont(c, 0.5) median_size FROM (SELECT CAST(count(*) AS DOUBLE) c FROM part GROUP BY p_name)")

E_ = "e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), par AS (SELECT a.vec_id, max(b.vec_id) p FROM e a JOIN e b ON b.vec_id < a.vec_id AND list_dot_product(a.v, b.v) > 0.3{band} GROUP BY 1)"
ROOTS = "r(vec_id, root) AS (SELECT e.vec_id, e.vec_id FROM e LEFT JOIN par USING (vec_id) WHERE par.p IS NULL UNION ALL SELECT par.vec_id, r.root FROM par JOIN r ON par.p = r.vec_id)"
add("backward_links", lambda s, d: linking.backward_links(vectors(s, d), THRESHOLD, limit=50).select("seq", "parent"), f"WITH {E_.format(band=' AND b.vec_id >= a.vec_id - 50')} SELECT e.vec_id seq, par.p parent FROM e LEFT JOIN par USING (vec_id)")
add("backward_cluster", lambda s, d: linking.backward_cluster(vectors(s, d), THRESHOLD), f"WITH RECURSIVE {E_.format(band='')}, {ROOTS} SELECT vec_id seq, root cluster_id FROM r")
for name in strategies.STRATEGIES:
    add(f"stream_{name}", lambda s, d, name=name: strategies.link(vectors(s, d), name, THRESHOLD, 50).select("seq", "cluster_id"), f"WITH RECURSIVE {E_.format(band=' AND b.vec_id >= a.vec_id - 50')}, {ROOTS} SELECT vec_id seq, root cluster_id FROM r" if name == "backwards" else None)
S_ = "s AS (SELECT DISTINCT p_name m, lower(p_name) x FROM part), g AS (SELECT m, substr(x, i, 2) term, CAST(count(*) AS DOUBLE) c FROM s, unnest(range(1, length(x))) u(i) GROUP BY 1, 2), nn AS (SELECT m, sqrt(sum(c * c)) l FROM g GROUP BY 1), w AS (SELECT m, term, c / l w FROM g JOIN nn USING (m)), sim AS (SELECT a.m a, b.m b, round(sum(a.w * b.w), 9) score FROM w a JOIN w b USING (term) GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) > 0.8)"
add("bigram_tf", lambda s, d: linking.bigram_weights(parts(s, d)).select("mention", "term", F.round("w", 6).alias("w")), f"WITH {S_} SELECT m mention, term, round(w, 6) w FROM w")
add("mention_similarity", lambda s, d: linking.similar_strings(linking.bigram_weights(parts(s, d)), 0.8).select("a", "b", F.round("score", 6).alias("score")), f"WITH {S_} SELECT a, b, round(score, 6) score FROM sim")
add(
    "feature_cluster",
    lambda s, d: linking.overwrite_cluster(parts(s, d), linking.similar_strings(linking.bigram_weights(parts(s, d)), 0.8)),
    f"WITH RECURSIVE {S_}, near AS (SELECT y.p_partkey seq, x.p_partkey o FROM part x JOIN sim ON sim.a = x.p_name JOIN part y ON y.p_name = sim.b), "
    "par AS (SELECT seq, max(o) FILTER (o < seq) p, max(o) l FROM near GROUP BY 1), own AS (SELECT p_partkey seq, p, coalesce(l, p_partkey) l FROM part LEFT JOIN par ON seq = p_partkey), "
    "r(seq, root) AS (SELECT seq, seq FROM own WHERE p IS NULL UNION ALL SELECT own.seq, r.root FROM own JOIN r ON own.p = r.seq) SELECT own.seq, r.root cluster_id FROM own JOIN r ON r.seq = own.l",
)


def heap(spark: SparkSession, d: str) -> DataFrame:
    """A binary tree over the embeddings rows: row i hangs under (i - 1) div 2; the leaves' labels count."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), F.when(F.col("vec_id") > 0, F.floor((F.col("vec_id") - 1) / 2)).alias("parent"), F.col("label").cast("string").alias("label"))


TREE = "tr AS (SELECT vec_id uid, CASE WHEN vec_id > 0 THEN (vec_id - 1) // 2 END parent, CAST(label AS VARCHAR) label FROM embeddings), cl(node, via, leaf) AS (SELECT uid, CAST(NULL AS BIGINT), uid FROM tr WHERE uid NOT IN (SELECT parent FROM tr WHERE parent IS NOT NULL) UNION ALL SELECT tr.parent, tr.uid, cl.leaf FROM cl JOIN tr ON tr.uid = cl.node WHERE tr.parent IS NOT NULL)"
add("tree_leaves", lambda s, d: trees.leaves(heap(s, d)).select("uid", "label"), f"WITH RECURSIVE {TREE} SELECT uid, label FROM tr WHERE uid NOT IN (SELECT parent FROM tr WHERE parent IS NOT NULL)")
add("tree_closure", lambda s, d: trees.leaf_paths(heap(s, d)).select("node", "via", "leaf"), f"WITH RECURSIVE {TREE} SELECT * FROM cl")
add("dendrogram_purity", lambda s, d: trees.purity(heap(s, d)), f"WITH RECURSIVE {TREE}, h AS (SELECT node, via, label, count(*)::DOUBLE c FROM cl JOIN tr l ON l.uid = cl.leaf WHERE via IS NOT NULL GROUP BY 1, 2, 3), nl AS (SELECT node, sum(c) n FROM h GROUP BY 1), pr AS (SELECT node, label, (sum(c) * sum(c) - sum(c * c)) / 2 pairs, sum(c) tot FROM h GROUP BY 1, 2) SELECT round(sum(pairs * tot / n) / sum(pairs), 6) purity FROM pr JOIN nl USING (node)")

V_ = ", unnest(range(1, len(embedding) + 1)) u(i)"
MEANS = f"m AS (SELECT node, via, i pos, avg(embedding[i]::DOUBLE) v FROM cl JOIN embeddings e ON e.vec_id = cl.leaf{V_} WHERE via IS NOT NULL GROUP BY 1, 2, 3), sc AS (SELECT a.node, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) score FROM m a JOIN m b ON a.node = b.node AND a.pos = b.pos AND a.via < b.via GROUP BY 1)"
CUT = 0.05


def uids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")


def tree_cut(spark: SparkSession, d: str) -> DataFrame:
    paths = trees.leaf_paths(heap(spark, d))
    return trees.cut(paths, trees.scores(paths, uids(spark, d)), CUT)


DEPTH = TREE.replace("cl(node, via, leaf)", "cl(node, via, leaf, h)").replace("CAST(NULL AS BIGINT), uid FROM tr", "CAST(NULL AS BIGINT), uid, 0 FROM tr").replace("tr.uid, cl.leaf FROM", "tr.uid, cl.leaf, h + 1 FROM")
add("tree_centroids", lambda s, d: trees.centroids(trees.leaf_paths(heap(s, d)), uids(s, d)).select("node", "pos", F.round("value", 6).alias("value")), f"WITH RECURSIVE {TREE} SELECT node, CAST(i - 1 AS INTEGER) pos, round(avg(embedding[i]::DOUBLE), 6) value FROM cl JOIN embeddings e ON e.vec_id = cl.leaf{V_} GROUP BY 1, 2")
add("tree_scores", lambda s, d: trees.scores(trees.leaf_paths(heap(s, d)), uids(s, d)).select("node", F.round("score", 6).alias("score")), f"WITH RECURSIVE {TREE}, {MEANS} SELECT node, round(score, 6) score FROM sc")
add("tree_cut", tree_cut, f"WITH RECURSIVE {DEPTH}, {MEANS} SELECT leaf, arg_max(cl.node, h) cluster_id FROM cl LEFT JOIN sc USING (node) WHERE via IS NULL OR score >= {CUT} GROUP BY 1")

for norm, over in (("l2", "sqrt(sum(v * v))"), ("linf", "max(abs(v))"), ("none", "1.0")):
    add(f"centroids_{norm}", lambda s, d, norm=norm: vec.centroids(read(s, d, "embeddings"), "label", norm="l_inf" if norm == "linf" else norm).select("label", "pos", F.round("value", 6).alias("value")), f"WITH m AS (SELECT label, i - 1 pos, avg(embedding[i]::DOUBLE) v FROM embeddings{V_} GROUP BY 1, 2), z AS (SELECT label, {over} z FROM m GROUP BY 1) SELECT label, CAST(pos AS INTEGER) pos, round(v / z, 6) value FROM m JOIN z USING (label)")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the next one."""
    a = read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("a"))
    return a.join(a.select((F.col("seq") - 1).alias("seq"), F.col("a").alias("b")), "seq")


NEXT = "FROM (SELECT a.vec_id seq, a.embedding::DOUBLE[] a, b.embedding::DOUBLE[] b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
for name, own, formula in (("sim_dot", vec.dot, "list_dot_product(a, b)"), ("sim_l2", vec.sim_l2, "1 / (1 + list_distance(a, b))"), ("sim_sql2", vec.sim_sql2, "1 / (1 + list_distance(a, b) * list_distance(a, b))")):
    add(name, lambda s, d, own=own: neighbours(s, d).select("seq", F.round(own(F.col("a"), F.col("b")), 6).alias("score")), f"SELECT seq, round({formula}, 6) score {NEXT}")
add("l2_normalize", lambda s, d: read(s, d, "embeddings").select("vec_id", F.posexplode(vec.l2_normalize(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x")), f"SELECT vec_id, CAST(i - 1 AS INTEGER) pos, round(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) x FROM embeddings{V_}")

W_ = "(SELECT {k} k, unnest(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) term FROM {t})"
IDF = "c AS (SELECT rid, term, count(*) c FROM rw GROUP BY 1, 2), tm AS (SELECT term, sum(c) a, count(*) df FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000), idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 idf FROM tm, rn)"
add("tfidf", lambda s, d: text.tfidf_weights(read(s, d, "documents"), "doc_id", "text", text.fit_idf(read(s, d, "documents"), "text")).select("doc_id", "term", F.round("w", 6).alias("w")), f"WITH rw AS (SELECT k rid, term FROM {W_.format(k='doc_id', x='text', t='documents')}), rn AS (SELECT count(*) n FROM documents), {IDF}, w AS (SELECT rid, term, c * idf w FROM c JOIN idf USING (term)), l AS (SELECT rid, sqrt(sum(w * w)) l FROM w GROUP BY 1) SELECT rid doc_id, term, round(w / l, 6) w FROM w JOIN l USING (rid)")
FEATURE = 0.95
add("feature_score", lambda s, d: text.feature_score(parts(s, d).withColumnRenamed("document_id", "context"), FEATURE), f"WITH rw AS (SELECT k rid, term FROM {W_.format(k='p_partkey', x='p_type', t='part')}), rn AS (SELECT count(*) n FROM part), {IDF}, {S_}, x AS (SELECT DISTINCT p_type k FROM part), xt AS (SELECT k, term, count(*) c FROM {W_.format(k='k', x='k', t='x')} GROUP BY 1, 2), xw AS (SELECT k, term, c * idf w FROM xt JOIN idf USING (term)), xl AS (SELECT k, sqrt(sum(w * w)) l FROM xw GROUP BY 1), xn AS (SELECT k, term, w / l w FROM xw JOIN xl USING (k)), xs AS (SELECT a.k a, b.k b, round(sum(a.w * b.w), 9) c FROM xn a JOIN xn b USING (term) GROUP BY 1, 2), p AS (SELECT DISTINCT p_name m, p_type k FROM part) SELECT p.m mention_a, p.k context_a, q.m mention_b, q.k context_b, round(0.8 * score + 0.2 * c, 6) score FROM p JOIN sim ON sim.a = p.m JOIN xs ON xs.a = p.k JOIN p q ON q.m = sim.b AND q.k = xs.b WHERE round(0.8 * score + 0.2 * c, 6) > {FEATURE}")


def combined(spark: SparkSession, d: str) -> DataFrame:
    return text.combo_score(parts(spark, d).select("seq", "mention").join(vectors(spark, d).select("seq", "embedding"), "seq"), 0.6)


add("combo_score", combined, f"WITH {S_.replace('> 0.8', '> -1')}, r AS (SELECT vec_id seq, embedding::DOUBLE[] v, p_name m FROM embeddings JOIN part ON p_partkey = vec_id), f AS (SELECT x.seq, y.seq earlier, round(0.5 * coalesce(score, 0) + 0.5 * list_dot_product(x.v, y.v), 6) score FROM r x JOIN r y ON y.seq < x.seq LEFT JOIN sim ON sim.a = x.m AND sim.b = y.m) SELECT * FROM f WHERE score > 0.6")
add("ceaf_e", lambda s, d: metrics.ceaf_e(assigned(s, d)))
add("coref_scores", lambda s, d: metrics.coref_scores(assigned(s, d)))
DRAW = "CAST('0x' || substr(md5('1234:' || {}), 1, 15) AS BIGINT)"
add("chunk_shuffle", lambda s, d: sampling.chunk_shuffle(events(s, d), 1024).select("seq", "chunk", "place"), f"SELECT event_id seq, event_id // 1024 chunk, row_number() OVER (PARTITION BY event_id // 1024 ORDER BY {DRAW.format('event_id')}, event_id) - 1 place FROM events")
add("triplets", lambda s, d: sampling.triplets(events(s, d)), f"WITH m AS (SELECT user_id e, event_id s, {DRAW.format('event_id')} d FROM events), g AS (SELECT e, arg_min(s, d) a, arg_max(s, d) b FROM m GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY {DRAW.format('e')}, e) - 1 n, count(*) OVER () c FROM g) SELECT x.e entity, x.a anchor, x.b positive, y.a negative FROM k x JOIN k y ON y.n = (x.n + 1) % x.c WHERE x.a <> x.b AND x.c > 1")
add("shard", lambda s, d: sampling.shard(events(s, d), 1, 4).select("seq"), "SELECT event_id seq FROM events WHERE event_id % 4 = 1")
add("hierarchy", lambda s, d: hierarchy.flat(hierarchy.build(vectors(s, d), limit=64, pruning="similarity"), THRESHOLD).select("seq", "cluster_id"))


# Mentions of documents: titles are a text's first two words, each document links to one of fifty.
def titled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.substring_index("text", " ", 2).alias("title"), "text", F.col("lang").alias("category"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("context_document_id"), (F.col("doc_id") % 50).cast("string").alias("label_document_id"), F.lit(2).alias("start_index"), F.lit(4).alias("end_index"))


TITLED = (
    "ti AS (SELECT CAST(doc_id AS VARCHAR) document_id, array_to_string(string_split(text, ' ')[1:2], ' ') title, text, lang category FROM documents), "
    "li AS (SELECT doc_id seq, CAST(doc_id AS VARCHAR) context_document_id, CAST(doc_id % 50 AS VARCHAR) label_document_id FROM documents), "
    "tk AS (SELECT document_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') t FROM ti), "
    "lm AS (SELECT seq, array_to_string(t[1:2], ' ') left_context, array_to_string(t[3:5], ' ') mention, array_to_string(t[6:], ' ') right_context, lab.title entity_id, con.category, con.document_id "
    "FROM li JOIN ti lab ON lab.document_id = label_document_id JOIN ti con ON con.document_id = context_document_id JOIN tk ON tk.document_id = context_document_id), "
    "us AS (SELECT label_document_id document_id, min(seq) seq FROM li GROUP BY 1), "
    "pg AS (SELECT seq, '' left_context, title mention, trim(CASE WHEN instr(text, title) > 0 AND title <> '' THEN substr(text, 1, instr(text, title) - 1) || substr(text, instr(text, title) + length(title)) ELSE text END, ' ') right_context, title entity_id, category, document_id "
    "FROM us JOIN ti USING (document_id))"
)
add("mention_doc_join", lambda s, d: mention_ops.linked_mentions(links(s, d), titled(s, d)).drop("label_document_id"), f"WITH {TITLED} SELECT * FROM lm")
add("entity_page_union", lambda s, d: mention_ops.entity_pages(links(s, d), titled(s, d)), f"WITH {TITLED} SELECT * FROM pg")
add(
    "mention_index",
    lambda s, d: mention_ops.with_pages(links(s, d), titled(s, d)).select("document_id", "mention", "mention_index"),
    f"WITH {TITLED}, al AS (SELECT *, 0 k FROM lm UNION ALL SELECT *, 1 FROM pg) SELECT document_id, mention, row_number() OVER (ORDER BY category, k, seq, document_id) - 1 mention_index FROM al",
)
add("category_count", lambda s, d: mention_ops.category_counts(links(s, d)), f"WITH {TITLED} SELECT label_document_id document_id, count(*) + 1 count FROM li GROUP BY 1")
add("nil_filter", lambda s, d: mention_ops.not_nil(read(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", mention_ops.NIL).otherwise(F.col("event_type")).alias("entity_id"))), "SELECT event_id, event_type entity_id FROM events WHERE event_type <> 'view'")
add("valid_mention_filter", lambda s, d: read(s, d, "part").filter(mention_ops.is_valid(F.upper("p_type"), F.filter(F.split("p_name", " "), lambda x: F.length(x) > 4))).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT contains(upper(p_type), 'ACT') AND NOT contains(upper(p_type), 'NEG') AND len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) > 0")
add("docid_regex", lambda s, d: read(s, d, "pages").select("page_id", corpora.docid(F.concat(F.lit("(("), F.col("url"), F.lit(") x) y"))).alias("docid")), "SELECT page_id, '(' || url || ') x' docid FROM pages")
add("date_format", lambda s, d: events(s, d).select("seq", F.date_format("date", "dd/MM/yyyy").alias("date")), f"SELECT seq, strftime(date, '%d/%m/%Y') date FROM {EV}")
add("composite_key", lambda s, d: parts(s, d).select("seq", mention_ops.composite("entity_id", "document_id").alias("key")), "SELECT p_partkey seq, p_brand || '::' || p_type AS \"key\" FROM part")
add(
    "pretty_mention",
    lambda s, d: mention_ops.linked_mentions(links(s, d), titled(s, d)).select("seq", mention_ops.pretty().alias("shown")),
    f"WITH {TITLED}, e AS (SELECT seq, " + ", ".join(f"regexp_replace({c}, '([{{{{}}}}_%])', '\\\\\\1', 'g') {c}" for c in ("left_context", "mention", "right_context")) + " FROM lm) "
    "SELECT seq, '\\ldots ' || array_to_string(list_slice(string_split(left_context, ' '), greatest(len(string_split(left_context, ' ')) - 9, 1), len(string_split(left_context, ' '))), ' ') || ' \\emph{{' || mention || '}} ' || array_to_string(string_split(right_context, ' ')[1:10], ' ') || ' \\ldots' shown FROM e".replace("{{", "{").replace("}}", "}"),
)
add("split_routing", lambda s, d: mention_ops.routed(parts(s, d).select("seq", F.col("document_id").alias("pmid")), {n: parts(s, d).filter(F.col("seq") % 3 <= i).select(F.col("document_id").alias("id")).distinct() for i, n in enumerate(("train", "dev", "test"))}).select("seq", "split"), "SELECT p_partkey seq, CASE min(p_partkey % 3) OVER (PARTITION BY p_type) WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END split FROM part")
add("cluster_count", lambda s, d: assigned(s, d).agg(F.countDistinct("pred_id").alias("n_pred")), "SELECT count(DISTINCT p_name) n_pred FROM part")
for kind in ("seen", "unseen"):
    add(
        f"eval_{kind}",
        lambda s, d, kind=kind: metrics.allowed(assigned(s, d), parts(s, d), parts(s, d).filter("seq % 5 = 0 and entity_id < 'Brand#3'"), kind),
        f"WITH {A} SELECT * FROM a WHERE true_id {'' if kind == 'seen' else 'NOT '}IN (SELECT true_id FROM a WHERE seq % 5 = 0 AND true_id < 'Brand#3')",
    )
add(
    "split_samples",
    lambda s, d: metrics.mixed_samples(assigned(s, d), parts(s, d).withColumn("left_context", F.lit("")).withColumn("right_context", F.lit(""))).select("kind", "seq"),
    f"WITH {A}, sp AS (SELECT true_id FROM a GROUP BY 1 ORDER BY count(DISTINCT pred_id) DESC, min(seq) LIMIT 1), co AS (SELECT pred_id FROM a GROUP BY 1 ORDER BY count(DISTINCT true_id) DESC, min(seq) LIMIT 1) "
    "SELECT 'split' kind, seq FROM (SELECT seq FROM a JOIN sp USING (true_id) ORDER BY seq LIMIT 5) UNION ALL SELECT 'conflated', seq FROM (SELECT min(seq) seq FROM a JOIN co USING (pred_id) GROUP BY true_id ORDER BY 1 LIMIT 5)",
)
BEST = "e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), be AS (SELECT a.vec_id, max(list_dot_product(a.v, b.v)) best FROM e a LEFT JOIN e b ON b.vec_id < a.vec_id GROUP BY 1)"
add(
    "find_threshold",
    lambda s, d: linking.find_threshold(vectors(s, d)).select(F.round("threshold", 9).alias("threshold"), "n_clusters", "met"),
    f"WITH RECURSIVE {BEST}, tg AS (SELECT count(DISTINCT label) t, count(*) n FROM embeddings), "
    "s(i, lo, hi, c) AS (SELECT 1, 0.0::DOUBLE, 1.0::DOUBLE, (SELECT count(*) FROM be WHERE best IS NULL OR best <= 0.5) UNION ALL "
    "SELECT i + 1, CASE WHEN c < t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < t THEN hi ELSE (lo + hi) / 2 END, "
    "(SELECT count(*) FROM be WHERE best IS NULL OR best <= (CASE WHEN c < t THEN (lo + 3 * hi) / 4 ELSE (3 * lo + hi) / 4 END)) FROM s, tg WHERE abs(c - t) > n / 1000.0 AND i < 40) "
    "SELECT round((lo + hi) / 2, 9) threshold, c n_clusters, abs(c - t) <= n / 1000.0 met FROM s, tg ORDER BY i DESC LIMIT 1",
)
add("bigram_fitted", lambda s, d: linking.bigram_weights(parts(s, d), vocabulary=linking.bigram_vocabulary(parts(s, d).filter("seq % 7 = 0"))).select("mention", "term", F.round("w", 6).alias("w")), f"WITH {S_.replace('nn AS (', 'fv AS (SELECT DISTINCT term FROM g JOIN part ON p_name = m WHERE p_partkey % 7 = 0), gg AS (SELECT * FROM g JOIN fv USING (term)), nn AS (').replace('FROM g GROUP BY 1)', 'FROM gg GROUP BY 1)').replace('FROM g JOIN nn', 'FROM gg JOIN nn')} SELECT m mention, term, round(w, 6) w FROM w")
FEATURE_LOW = 0.6
add(
    "feature_score_low",
    lambda s, d: text.feature_score(parts(s, d).filter("seq < 300").withColumnRenamed("document_id", "context"), FEATURE_LOW).agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total")),
    None,
)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding's first eight components as scores, the first of them gold's."""
    return read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("scores"))


add("linking_loss", lambda s, d: scored(s, d).select("vec_id", F.round(training.nll(F.col("scores")), 6).alias("loss"), training.first_wins(F.col("scores")).alias("right")), "WITH c AS (SELECT vec_id, embedding[1:8]::DOUBLE[] s FROM embeddings) SELECT vec_id, round(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[1], 6) loss, s[1] >= list_max(s) AS \"right\" FROM c")
add("linking_report", lambda s, d: training.linking_report(scored(s, d)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss")), "WITH c AS (SELECT embedding[1:8]::DOUBLE[] s FROM embeddings) SELECT count(*) n, round(avg(CASE WHEN s[1] >= list_max(s) THEN 1.0::DOUBLE ELSE 0.0 END), 6) accuracy, round(avg(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[1]), 6) loss FROM c")
add("triplet_hinge", lambda s, d: scored(s, d).select("vec_id", F.round(training.hinge(F.get("scores", F.lit(0)), F.get("scores", F.lit(1))), 6).alias("loss")), "SELECT vec_id, round(greatest(0.0::DOUBLE, 1.0 - embedding[1]::DOUBLE + embedding[2]::DOUBLE), 6) loss FROM embeddings")
add("batch_negatives", lambda s, d: training.batch_negatives(vectors(s, d).select("seq", F.col("entity_id").alias("idx"), F.floor(F.col("seq") / 16).alias("batch"))), "SELECT a.vec_id seq, b.vec_id other, CASE WHEN a.label = b.label THEN 0 ELSE b.label END negative FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16")


def coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocab = corpus.entity_vocab(train_of(events(spark, d))[0])
    return corpus.entity_encode(events(spark, d), vocab).select("seq", "idx"), vocab


add("weighted_negatives", lambda s, d: training.weighted_negatives(*coded(s, d), 8))
add("uniform_negatives", lambda s, d: training.uniform_negatives(coded(s, d)[0], 1000, 8))
add("encoded_mentions", lambda s, d: training.encoded(mention_ops.linked_mentions(links(s, d), titled(s, d)).select("seq", "left_context", "mention", "right_context"), 32).select("seq", F.array_join("tokens", " ").alias("tokens")))
add("hierarchy_compat", lambda s, d: hierarchy.flat(hierarchy.build(vectors(s, d), limit=64, pruning="similarity", compat=True), THRESHOLD).select("seq", "cluster_id"))
add("hierarchy_blocks", lambda s, d: hierarchy.flat(hierarchy.build(vectors(s, d).withColumn("block", F.col("entity_id") % 8), block="block", limit=64), THRESHOLD).select("block", "seq", "cluster_id"))
