import json

from pyspark.sql import functions as F

from mentionflow.functions import vectors
from mentionflow.operators import sampling
from mentionflow.sources import readers, writers


def test_pubtator(spark, tmp_path):
    f = tmp_path / "corpus.txt"
    f.write_text("1|t|A b|c\n1|a|Dé f.\n1\t0\t1\tA\tT1\tE1\n1\t6\t8\tDé\tT2\tE2\n\n\n\n2|t|Only\n2|a|x\n2\t0\t4\tOnly\tT1\tE3")
    got = {(r["pmid"], r["mention_index"]): r for r in readers.pubtator(spark, str(f)).collect()}
    assert set(got) == {("1", 0), ("1", 1), ("2", 0)}
    assert (got["1", 1]["title"], got["1", 1]["left_context"], got["1", 1]["right_context"], got["1", 1]["entity_id"]) == ("A b|c", "A b|c ", " f.", "E2")
    assert got["2", 0]["right_context"] == " x"


def test_round_trips(spark, tmp_path):
    vec = spark.createDataFrame([("a", "e1", [0.5, -1.0]), ("b", "e2", [2.0, 3.25])], "uid string, entity_id string, embedding array<double>")
    writers.embeddings_tsv(vec, str(tmp_path / "v"))
    assert sorted(map(tuple, readers.embeddings_tsv(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, vec.collect()))
    vocab = spark.createDataFrame([("x, y", 3, 1), ("[PAD]", 0, 0), ("z", 1, 2)], "entity string, count long, idx long")
    writers.vocabulary(vocab, str(tmp_path / "w"))
    assert sorted(map(tuple, readers.vocabulary(spark, str(tmp_path / "w")).collect())) == sorted(map(tuple, vocab.collect()))
    tree = spark.createDataFrame([("1", None, None), ("2", "1", "l")], "uid string, parent string, label string")
    writers.dendrogram(tree, str(tmp_path / "t"))
    assert {tuple(r) for r in readers.dendrogram(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in tree.collect()}
    pairs = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "true_id string, pred_id string, seq long")
    writers.assignments(pairs, str(tmp_path / "p"))
    assert {tuple(r) for r in readers.assignments(spark, str(tmp_path / "p")).collect()} == {tuple(r) for r in pairs.collect()}


def test_json_formats(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text(json.dumps({"id": "7", "output": [{"answer": "E"}, {"answer": "F"}], "meta": {"left_context": "l", "mention": "m", "right_context": "r"}}) + "\n" + json.dumps({"id": "8", "output": []}) + "\n")
    assert {tuple(r) for r in readers.kilt(spark, str(tmp_path / "k.jsonl")).collect()} == {("7", "E", "m", "l", "r"), ("8", None, None, None, None)}
    d = tmp_path / "docs"
    d.mkdir()
    (d / "lego.json").write_text('{"title": "a"}\n')
    assert [tuple(r) for r in readers.json_directory(spark, str(d), "title string").collect()] == [("a", "lego")]
    (tmp_path / "ids").write_text(" 1 \n2\n\n1\n")
    assert sorted(r["id"] for r in readers.id_list(spark, str(tmp_path / "ids")).collect()) == ["1", "2"]


def test_sql_functions(spark):
    vectors.register(spark)
    got = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) a, vec_sim_l2(array(0D), array(3D)) b, vec_sim_sql2(array(0D), array(3D)) c").first()
    assert tuple(got) == (11.0, 0.25, 0.1)
    zero = spark.range(1).select(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first()
    assert zero["v"] == [0.0, 0.0]


def test_context_window(spark):
    df = spark.createDataFrame([(list("abc"), ["M"], list("uvwxyz"))], "l array<string>, m array<string>, r array<string>")
    for size, left, right in ((15, "abc", "uvwxyz"), (11, "abc", "uvw"), (9, "bc", "uv"), (5, "", ""), (13, "abc", "uvwxy")):
        got = df.select(*sampling.context_window(F.col("l"), F.col("m"), F.col("r"), size)).first()
        assert ("".join(got["left"]), "".join(got["right"])) == (left, right)
