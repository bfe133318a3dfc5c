import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionflow.operators import corpus, mentions
from mentionflow.sources import corpora, readers, writers


def test_token_lines(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text("-DOCSTART- (1 EU)\nEU\tB\tEU\t--NME--\nrejects\nGerman\tB\tGerman call\tGermany\ncall\tI\tGerman call\tGermany\n\n-DOCSTART- (2 x (y))\nRome\tB\tRome\tRome\n.\n\n-DOCSTART- (947testa CRICKET)\nA\tB\tA\tA1\nB\tB\tB\tB1\n\n")
    lines = corpora.token_lines(spark, str(f))
    found = {(r["document_id"], r["mention"]): r for r in corpora.token_mentions(lines).collect()}
    assert set(found) == {("1 EU", "EU"), ("1 EU", "German call"), ("2 x (y)", "Rome"), ("947testa CRICKET", "A"), ("947testa CRICKET", "B")}
    german = found["1 EU", "German call"]
    assert (german["left_context"], german["right_context"], german["entity_id"], german["start"], german["end"]) == ("EU rejects ", "", "Germany", 11, 22)
    # The last two lines have no space after them, and the last one is blank.
    assert {r["text"] for r in lines.filter("document_id = '2 x (y)'").collect()} == {"Rome ."}
    routed = {(r["mention"], r["split"], r["mention_index"]) for r in mentions.sections(corpora.token_mentions(lines), lines).collect()}
    assert routed == {("German call", "train", 0), ("Rome", "train", 1), ("A", "dev", 0), ("B", "dev", 1)}


XML = """<Document doc_name="1_2.xml">
<token t_id="1" sentence="0" number="0">Ann</token><token t_id="2" sentence="0" number="1">saw</token><token t_id="3" sentence="1" number="0">the</token><token t_id="4" sentence="1" number="1">old</token><token t_id="5" sentence="1" number="2">dog</token>
<Markables><HUMAN m_id="1"><token_anchor t_id="1"/></HUMAN><ACTION m_id="2"><token_anchor t_id="2"/></ACTION><ANIMAL m_id="3"><token_anchor t_id="3"/><token_anchor t_id="5"/></ANIMAL><HUMAN m_id="4"/></Markables>
<Relations><CROSS r_id="9"><source m_id="3"/><target m_id="1"/></CROSS><CROSS r_id="8"><source m_id="2"/><target m_id="4"/></CROSS></Relations></Document>"""


def test_event_xml(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "1_2.xml").write_text(XML)
    (tmp_path / "1" / "1_3.xml").write_text("<broken")
    (tmp_path / "gold.csv").write_text("Topic,File,Sentence Number\n1,2,1\n1,3,0\n36,2,0\n")
    gold = corpora.gold_sentences(spark, str(tmp_path / "gold.csv"))
    assert {(r["topic"], r["file"], r["split"]) for r in gold.collect()} == {("1", "2", "train"), ("1", "3", "train"), ("36", "2", "test")}
    files = corpora.event_xml(spark, str(tmp_path))
    got = [tuple(r) for r in mentions.event_mentions(files, gold).collect()]
    assert got == [("train", "1", "2", "9", "Ann saw", "the old dog", "")]
    both = gold.withColumn("sentences", F.array(F.lit("0"), F.lit("1")))
    assert {r["mention"] for r in mentions.event_mentions(files, both).collect()} == {"the old dog", "Ann"}


def test_pages(spark, tmp_path):
    for folder in ("documents", "mentions"):
        (tmp_path / folder).mkdir()
    (tmp_path / "documents" / "lego.json").write_text("\n".join(json.dumps(x) for x in ({"document_id": "a", "title": "Red brick", "text": "Red brick is a Red brick ."}, {"document_id": "b", "title": "Car", "text": "one two three four"})))
    (tmp_path / "mentions" / "train.json").write_text("\n".join(json.dumps({"context_document_id": "b", "label_document_id": x, "start_index": i, "end_index": i + 1}) for i, x in enumerate("aba")))
    documents, links = corpora.page_documents(spark, str(tmp_path / "documents")), corpora.page_links(spark, str(tmp_path / "mentions"))
    got = [(r["mention"], r["entity_id"], r["left_context"], r["right_context"], r["category"]) for r in mentions.with_pages(links, documents).orderBy("mention_index").collect()]
    assert got == [("one two", "Red brick", "", "three four", "lego"), ("two three", "Car", "one", "four", "lego"), ("three four", "Red brick", "one two", "", "lego"), ("Red brick", "Red brick", "", "is a Red brick .", "lego"), ("Car", "Car", "", "one two three four", "lego")]
    assert {(r["document_id"], r["count"]) for r in mentions.category_counts(links).collect()} == {("a", 3), ("b", 2)}


def test_pubtator_with_windows_lines(spark, tmp_path):
    text = "1|t|A b\n1|a|De f.\n1\t0\t1\tA\tT1,T2\tE1\n\n2|t|Only\n2|a|x\n2\t0\t4\tOnly\tT1\tE3\n2\t5\t6\tx\tT1\tE4\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "w.txt").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "c" / "u.txt").write_bytes(text.replace("1|", "7|").replace("1\t0", "7\t0").replace("2|", "8|").replace("2\t", "8\t").encode())
    df = readers.pubtator(spark, str(tmp_path / "c"))
    assert sorted((r["pmid"], r["mention_index"], r["mention"], r["right_context"]) for r in df.collect()) == [("1", 0, "A", " b De f."), ("2", 0, "Only", " x"), ("2", 1, "x", ""), ("7", 0, "A", " b De f."), ("8", 0, "Only", " x"), ("8", 1, "x", "")]
    assert {(r["uid"], tuple(r["semantic_type"])) for r in corpora.metadata(df).collect()} >= {("1_0", ("T1", "T2")), ("2_1", ("T1",))}
    dates = spark.createDataFrame([("1", "2001/02/03 04:05"), ("2", "never"), ("7", "1999/12/31 00:00")], "pmid string, date string")
    assert {(r["pmid"], r["date_text"]) for r in corpora.dated(df, dates).collect()} == {("1", "03/02/2001"), ("7", "31/12/1999")}
    lists = {n: spark.createDataFrame([(x,) for x in ids], "id string") for n, ids in (("train", "12"), ("dev", "27"), ("test", "8"))}
    assert {(r["pmid"], r["split"]) for r in mentions.routed(df, lists).collect()} == {("1", "train"), ("2", "train"), ("7", "dev"), ("8", "test")}
    with pytest.raises(Exception, match="in no split: 8"):
        mentions.routed(df, {"train": lists["train"], "dev": lists["dev"]}).collect()


def test_assignments_number_their_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a, 1\nb, 2\n a ,1\n")
    assert [tuple(r) for r in readers.assignments(spark, str(tmp_path / "c.csv")).orderBy("seq").collect()] == [("a", "1", 0), ("b", "2", 1), ("a", "1", 2)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "e1", "x"), (1, "e2", "y"), (2, None, "z")], "seq long, entity_id string, mention string")
    writers.seen_unseen(df, df.filter("seq = 0"), str(tmp_path / "m"))
    assert [r["seq"] for r in spark.read.json(f"{tmp_path}/m.seen").collect()] == [0]
    assert sorted(r["seq"] for r in spark.read.json(f"{tmp_path}/m.unseen").collect()) == [1, 2]
    leaves = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "c")], "leaf string, cluster_id string")
    writers.tree_cut(leaves, spark.createDataFrame([("a", "E"), ("b", "F"), ("c", "E")], "leaf string, entity_id string"), str(tmp_path / "t"))
    cut = {r[2]: (r[0], r[1]) for r in spark.read.csv(str(tmp_path / "t")).collect()}
    assert cut["a"][1] == cut["b"][1] != cut["c"][1] and {x for _, x in cut.values()} == {"0", "1"} and cut["b"][0] == "F"
    vocab = corpus.entity_vocab(df)
    writers.entities(vocab, str(tmp_path / "v"))
    assert {(r["entity"], r["count"]) for r in readers.vocabulary(spark, str(tmp_path / "v")).collect()} >= {("[PAD]", 0), ("e1", 1)}


def test_samples_and_filters(spark):
    df = spark.createDataFrame([(i, "c", f"e{i % 3}", "--NME--" if i == 4 else None) for i in range(9)], "seq long, pred string, entity_id string, n string")
    assert [r["seq"] for r in mentions.samples(df, "pred", "c", 5).collect()] == [0, 1, 2, 3, 4]
    assert [r["seq"] for r in mentions.samples(df, "pred", "c", 5, distinct="entity_id").collect()] == [0, 1, 2]
    assert mentions.not_nil(df, "n").count() == 8
    assert [(r["entity_id"], r["seq"]) for r in mentions.last_of(df, "entity_id", "seq").orderBy("seq").collect()] == [("e0", 6), ("e1", 7), ("e2", 8)]
    text = " ".join(f"w{i}" for i in range(20))
    shown = spark.createDataFrame([(text, "a_b%", text)], "left_context string, mention string, right_context string").select(mentions.pretty()).first()[0]
    assert shown == "\\ldots " + " ".join(f"w{i}" for i in range(10, 20)) + " \\emph{a\\_b\\%} " + " ".join(f"w{i}" for i in range(10)) + " \\ldots"


def test_ranges_cut_ties(spark):
    from mentionflow.operators import ordered

    rng = np.random.default_rng(0)
    rows = [(int(x), i) for i, x in enumerate(rng.choice([1, 1, 1, 1, 2, 7], 900))] + [(None, 900), (None, 901)]
    df = spark.createDataFrame(rows, "k long, seq long").repartition(5)
    ranges = ordered.with_range(df, "k", "seq", 50).groupBy("_range").count().collect()
    assert len(ranges) > 10 and max(r["count"] for r in ranges) < 200
    want = {s: n for n, (_, s) in enumerate(sorted(((-1 if k is None else k), s) for k, s in rows))}
    assert {r["seq"]: r["n"] for r in ordered.row_number(df, "k", "n", ("seq",), 50).collect()} == want
    ids = ordered.dense_ids(spark.createDataFrame([(0, None, "a"), (1, "x", None), (2, None, "a"), (3, "x", None), (4, None, None)], "seq long, a string, b string"), ["a", "b"], "seq", "id")
    assert {r["seq"]: r["id"] for r in ids.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}
