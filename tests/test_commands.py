import json

import numpy as np
import pytest

from mentionflow.__main__ import COMMANDS, main
from mentionflow.sources import readers


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, d = np.random.default_rng(0), tmp_path_factory.mktemp("files")
    names = ["red ball", "red balls", "blue car", "green tree", "Rome"]
    middle = rng.normal(size=(5, 6))
    with open(d / "m.jsonl", "w") as f, open(d / "e.tsv", "w") as g:
        for i in range(40):
            k = i % 5
            f.write(json.dumps({"left_context": f"the {names[k][:3]} x{i}", "mention": names[k], "right_context": "is here now", "entity_id": f"E_{min(k, 3)}", "document_id": f"d{i // 10}", "uid": str(i)}) + "\n")
            v = middle[k] + rng.normal(size=6) / 9
            g.write("\t".join([str(i), f"E_{min(k, 3)}", *(f"{x:.5f}" for x in v)]) + "\n")
    return d


def assigned(spark, path):
    return {r["seq"]: r["pred_id"] for r in readers.assignments(spark, str(path)).collect()}


def test_clusterers(spark, files, capsys):
    run = lambda *a: main([str(x) for x in a], spark)
    m, e = files / "m.jsonl", files / "e.tsv"
    run("string_match", "--input", m, "--output", files / "s")
    got = assigned(spark, files / "s")
    assert len(got) == 40 and [got[i] for i in range(5)] == ["0", "1", "2", "3", "4"] and all(got[i] == got[i % 5] for i in range(40))
    run("oracle_wd", "--input", m, "--output", files / "o")
    assert len(set(assigned(spark, files / "o").values())) == 16
    run("fit_vectorizer", "--input", m, "--output", files / "v")
    run("baseline", "--input", m, "--output", files / "b", "--threshold", 0.55, "--vectorizer", files / "v")
    got = assigned(spark, files / "b")
    assert got[0] == got[1] == got[5] and got[0] != got[2]
    run("combo", "--input", m, "--output", files / "c", "--threshold", 0.9, "--embeddings", e)
    assert len(assigned(spark, files / "c")) == 40
    run("nn_thresh", "--input", e, "--output", files / "n")
    assert len(set(assigned(spark, files / "n").values())) <= 8
    run("nn_thresh", "--input", e, "--output", files / "n2", "--threshold", 0.8, "--limit", 6, "--strategy", "cache")
    assert len(assigned(spark, files / "n2")) == 40
    run("cluster_hierarchy", "--input", e, "--output", files / "h", "--threshold", 0.8, "--tree", files / "t")
    assert len(assigned(spark, files / "h")) == 40
    run("dendrogram_purity", "--tree", files / "t")
    assert float(capsys.readouterr().out.split()[-1]) > 0.5
    run("eval_clusters", "--input", files / "s")
    out = capsys.readouterr().out.strip().splitlines()
    assert out[0] == "True clusters: 4" and out[2] == "Pred clusters: 5" and len(out[3].split("\t")) == 11 and out[3].split("\t")[9] == "5.000"
    run("eval_clusters", "--input", files / "s", "--train", m, "--test", m, "--choice", "seen")
    assert capsys.readouterr().out.strip().splitlines()[3] == out[3]
    run("error_analysis", "--dataset", m, "--clusters", files / "s")
    out = capsys.readouterr().out
    assert "Conflated Entities: 0" in out and "Split Entities: 1" in out and "\\emph{green tree}" in out and "\\emph{Rome}" in out
    run("max_active", "--input", m)
    assert capsys.readouterr().out.strip() == "4"
    run("unique_entities", "--input", m)
    assert capsys.readouterr().out.split() == ["Unique:", "4", "Singletons:", "0"]
    run("split_unseen", "--train", m, "--eval", m)
    assert capsys.readouterr().out.strip() == "Percent Overlap: 1.0000"


def test_tree_cut(spark, files):
    (files / "tree.tsv").write_text("9\tNone\tNone\n0\t9\tx\n8\t9\tNone\n1\t8\tx\n5\t8\tx\n")
    main(["cut_tree", "--tree", str(files / "tree.tsv"), "--embeddings", str(files / "e.tsv"), "--threshold", "2", "--output", str(files / "cut")], spark)
    assert {r[2] for r in spark.read.csv(str(files / "cut")).collect()} == {"0", "1", "5"}


def test_encoders(spark, files, capsys):
    run = lambda *a: main([str(x) for x in a], spark)
    m = files / "m.jsonl"
    run("train_el", "--train", m, "--dev", m, "--test", m, "--output_dir", files / "model", "--epochs", 2, "--max_length", 16, "--negatives", 2)
    assert "accuracy" in capsys.readouterr().out
    assert spark.read.json(str(files / "model" / "metrics")).count() == 2
    for name in ("embed", "encode_mentions", "encode_quota"):
        run(name, "--input", m, "--output", files / name, "--model", files / "model", "--max_length", 24)
        assert readers.embeddings_tsv(spark, str(files / name)).filter("size(embedding) = 64").count() == 40
    run("pretokenize", "--input", m, "--output", files / "tokens", "--max_length", 12)
    assert {len(r["tokens"]) for r in readers.model(spark, str(files / "tokens")).collect()} == {12}


def test_preprocessors(spark, files, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    for name in ("train", "dev"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": str(i), "output": [{"answer": f"{name}{i % 2}"}], "meta": {"left_context": "l", "mention": "m", "right_context": "r"}}) + "\n" for i in range(3)))
    run("preprocess_kilt", "--train", tmp_path / "train.jsonl", "--dev", tmp_path / "dev.jsonl", "--prefix", tmp_path / "k")
    assert [(r["entity"], r["count"]) for r in readers.vocabulary(spark, f"{tmp_path}/k/entity_vocab").orderBy("idx").collect()] == [("[PAD]", 0), ("train0", 2), ("train1", 1)]
    (tmp_path / "p.txt").write_text("1|t|A b\n1|a|De f.\n1\t0\t1\tA\tT1\tE1\n\n2|t|C\n2|a|x\n2\t0\t1\tC\tT1\tE2\n")
    (tmp_path / "dates.csv").write_text("1,2001/02/03 04:05\n2,2000/01/01 00:00\n")
    run("preprocess_medmentions", "--pubtator_file", tmp_path / "p.txt", "--prefix", tmp_path / "d", "--dates", tmp_path / "dates.csv")
    got = spark.read.json(f"{tmp_path}/d/mentions")
    assert {(r["pmid"], r["date"], r["document_index"]) for r in got.collect()} == {("1", "03/02/2001", 1), ("2", "01/01/2000", 0)}
    for name, ids in (("train", "1"), ("dev", "2"), ("test", "3")):
        (tmp_path / name).write_text(ids + "\n")
    run("preprocess_medmentions", "--pubtator_file", tmp_path / "p.txt", "--prefix", tmp_path / "o", *(x for n in ("train", "dev", "test") for x in (f"--{n}", tmp_path / n)))
    assert {(r["pmid"], r["split"]) for r in spark.read.json(f"{tmp_path}/o/mentions").collect()} == {("1", "train"), ("2", "dev")}
    (tmp_path / "a.tsv").write_text("-DOCSTART- (1 EU)\nEU\tB\tEU\tE1\nx\n\n")
    run("preprocess_aida", "--input", tmp_path / "a.tsv", "--prefix", tmp_path / "a")
    assert [(r["mention"], r["mention_index"]) for r in spark.read.json(f"{tmp_path}/a/mentions").collect()] == [("EU", 0)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1_2.xml").write_text('<D><token t_id="1" sentence="0" number="0">Ann</token><Markables><HUMAN m_id="1"><token_anchor t_id="1"/></HUMAN></Markables><Relations><C r_id="9"><source m_id="1"/></C></Relations></D>')
    (tmp_path / "g.csv").write_text("Topic,File,Sentence Number\n1,2,0\n")
    run("preprocess_ecbplus", "--input", tmp_path / "x", "--gold", tmp_path / "g.csv", "--prefix", tmp_path / "e")
    assert [(r["mention"], r["entity_id"], r["split"]) for r in spark.read.json(f"{tmp_path}/e/mentions").collect()] == [("Ann", "9", "train")]
    for folder in ("documents", "mentions"):
        (tmp_path / "z" / folder).mkdir(parents=True)
    (tmp_path / "z" / "documents" / "lego.json").write_text(json.dumps({"document_id": "a", "title": "Car", "text": "a Car goes"}))
    (tmp_path / "z" / "mentions" / "train.json").write_text(json.dumps({"context_document_id": "a", "label_document_id": "a", "start_index": 1, "end_index": 1}))
    run("preprocess_zeshel", "--input", tmp_path / "z", "--prefix", tmp_path / "w")
    assert [r["mention"] for r in spark.read.json(f"{tmp_path}/w/train").orderBy("mention_index").collect()] == ["Car", "Car"]
    assert [(r["entity"], r["count"]) for r in readers.vocabulary(spark, f"{tmp_path}/w/entity_vocab").orderBy("idx").collect()] == [("[PAD]", 0), ("Car", 2)]


def test_every_command_has_help(capsys):
    for name in COMMANDS:
        with pytest.raises(SystemExit):
            main([name, "--help"])
        assert name in capsys.readouterr().out
