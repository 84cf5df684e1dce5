"""Engines, the service behind its cache, pooling, and the command lines, end to end."""

import csv
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridex.functions import vector
from meridex.functions import vocabulary as V
from meridex.plans import engines, report, tools
from meridex.sources import io, remote

COLUMNS = ["id", "text", "label", "urgency", "red_flags", "split", "group_id", "source", "embedding"]


def axis(k, off=0.0):
    v = [off] * len(V.LABELS)
    v[k] = 1.0
    return json.dumps(v)


def write(path, columns, rows):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerows([columns, *rows])
    return str(path)


@pytest.fixture
def gold(tmp_path):
    place = {label: k for k, label in enumerate(V.LABELS)}
    rows = [
        ("1", "ألم شديد مستمر يوقظني من النوم", V.IRREVERSIBLE, "Urgent", "", "test", "", "a", axis(place[V.DEEP])),  # a critical rule stays
        ("2", "مرحبا", V.DEEP, "Non-Urgent", "", "test", "", "a", axis(place[V.DEEP])),  # the model decides what the rules leave open
        ("3", "حساسية خفيفة من الحلو", V.REVERSIBLE, "Non-Urgent", "", "test", "", "b", axis(place[V.REVERSIBLE], 0.1)),  # a safe upgrade
        ("4", "حساسية خفيفة من الحلو جدا جدا", V.SURFACE, "Non-Urgent", "", "test", "", "b", ""),  # no vector: the rules alone
        ("5", "دم عند استخدام الخيط", V.GINGIVITIS, "Non-Urgent", "", "dev", "", "b", axis(0)),
    ]
    protos = write(tmp_path / "p.csv", ["label", "embedding"], [(label, axis(k)) for label, k in place.items()])
    return write(tmp_path / "g.csv", COLUMNS, rows), protos


def test_full_engine_from_the_command_line(spark, gold, tmp_path, capsys):
    path, protos = gold
    assert report.main([path, "--engine", "full", "--prototypes", protos, "--out", str(tmp_path / "full")]) == 0
    text = (tmp_path / "full" / "report.md").read_text(encoding="utf-8")
    assert "engine `full`" in text and "- accuracy: **1.000**" in text and "- calibration error" in text and text.endswith("- PASS\n")
    assert report.main([path, "--out", str(tmp_path / "rules")]) == 0
    with open(tmp_path / "rules" / "errors.csv", encoding="utf-8-sig", newline="") as f:
        errors = list(csv.DictReader(f))
    assert list(errors[0]) == ["id", "text", "gold_label", "pred_label", "gold_urgency", "pred_urgency", "confidence"]
    assert [(e["id"], e["gold_label"], e["pred_label"]) for e in errors] == [("2", V.DEEP, V.UNCLEAR), ("3", V.REVERSIBLE, V.SURFACE)]
    said = json.loads((tmp_path / "rules" / "report.json").read_text(encoding="utf-8"))
    assert said["result"]["n"] == 4 and said["warnings"][0] == "only 4 scored cases: confidence intervals are wide, treat numbers as indicative"
    assert "2 misclassified cases" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        report.main([path, "--split", "train"])
    with pytest.raises(ValueError, match="needs a column"):
        engines.predict("full", io.read_csv(spark, path).drop("embedding"))


def test_empty_split_aborts(spark, gold):
    rows = io.labelled(io.read_csv(spark, gold[0]))
    with pytest.raises(ValueError, match="no labelled rows in split 'dev'"):
        io.select_split(rows.where("split = 'test'"), "dev")
    with pytest.raises(ValueError, match="unknown split"):
        io.select_split(rows, "train")


def toy_loader():
    """Gives a model whose tokens are words and whose vectors are one axis for each label's first words."""

    def load():
        first = {s.split()[0]: k for k, texts in enumerate(V.PROTOTYPES.values()) for s in reversed(texts)}
        vec = lambda w: [float(first.get(w, -1) == k) for k in range(len(V.LABELS))]
        words = lambda t, most: t.split()[:most] or [""]
        return lambda texts, most: [([vec(w) for w in words(t, most)], [1] * len(words(t, most))) for t in texts]

    return load


def test_full_engine_with_an_encoder(spark, gold):
    rows = io.read_csv(spark, gold[0]).drop("embedding")
    got = engines.predict("full", rows, engines.Options(load=toy_loader())).orderBy("row_id").collect()
    assert [r.id for r in got] == ["1", "2", "3", "4", "5"] and all(0 <= r.confidence <= 0.9 for r in got)
    assert got[0].pred_label == V.IRREVERSIBLE and got[0].pred_urgency == "Urgent"


def test_pooling_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 255), ("c", 256), ("d", 400), ("e", 30), ("f", 3)):
        v, m = rng.normal(size=(n, 5)).astype(np.float32), (rng.random(n) < (0.0 if key == "e" else 0.8)).astype(int)
        if key == "d":
            m[:256] = 0  # only what is cut off would count
        rows += [(key, i, int(m[i]), v[i].tolist(), 1.0) for i in range(n)]
        mean = (v[:256].astype(float) * m[:256, None]).sum(0) / max(m[:256].sum(), 1e-9)
        want[key] = mean / max(np.sqrt((mean**2).sum()), 1e-12)
    rows += [("f", 1, None, [9.0] * 5, 1.0), ("f", 2, 1, None, 1.0)]
    t = spark.createDataFrame(rows, "seq string, pos int, mask int, embedding array<float>, x double").repartition(5)
    got = {r.seq: r.embedding for r in vector.pool_tokens(t, "seq").collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    inside = t.where("mask is not null and embedding is not null").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "mask", "embedding"))).alias("s"))
    for r in inside.select("seq", vector.masked_mean(F.col("s.embedding"), F.col("s.mask")).alias("v")).collect():
        assert np.allclose(r.v, want[r.seq], atol=1e-9)


@pytest.fixture
def service():
    """Fails each text's first request, and says how often each was sent and how many were under way together."""
    sent, under, lock = {}, [0, 0], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
            with lock:
                sent[text] = sent.get(text, 0) + 1
                under[0] += 1
                under[1] = max(under)
            fails = text == "never" or (sent[text] == 1 and text != "steady")
            body = json.dumps({"text": "hm"} if fails and len(text) % 2 else {"diagnosis": f"label of {text}", "urgency": "Urgent", "confidence": 0.5}).encode()
            self.send_response(500 if fails and len(text) % 2 == 0 else 200)
            self.end_headers()
            self.wfile.write(body)
            with lock:
                under[0] -= 1

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", sent, under
    server.shutdown()


def test_service_is_asked_once_for_each_text(spark, service, tmp_path):
    url, sent, under = service
    texts = ["steady", *[f"text {k}" for k in range(40)], "text 1", "text 1", None, ""]
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "row_id int, text string, result string")
    ask = lambda d: remote.remote_engine(d, remote.http_service(url, 10), str(tmp_path / "kept"), at_once=3, tasks=2, pause=0.01)
    got = {r.row_id: (r.pred_label, r.pred_urgency, r.confidence, r.pred_flags) for r in ask(df).collect()}
    assert got == {i: (f"label of {t or ''}", "Urgent", 0.5, []) for i, t in enumerate(texts)}
    assert sent == {"steady": 1, "": 2, **{f"text {k}": 2 for k in range(40)}} and under[1] <= 6
    before = dict(sent)
    more = df.unionByName(spark.createDataFrame([(99, "new", "r")], df.schema))
    assert ask(more).count() == len(texts) + 1 and {k: v for k, v in sent.items() if k != "new"} == before
    with pytest.raises(Exception, match="no answer after 4 tries"):
        ask(spark.createDataFrame([(0, "never", "r")], df.schema)).collect()
    assert ask(df).count() == len(texts) and sent["text 3"] == 2  # a failed run leaves what was kept before


def test_cache_computes_misses_only(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}.wav", bytes([i % 5])) for i in range(20)] + [("none.wav", None)], "path string, content binary")
    root, asked = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def compute(misses):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(result=[f"r{c[0]}" for c in b["content"]])[["key", "result"]]

        return misses.mapInPandas(run, "key string, result string")

    first = remote.cached_results(files.limit(8), root, "m", "ar", compute)
    assert {r.result for r in first.collect()} == {f"r{k}" for k in range(5)}
    n = asked.value
    every = {r.path: r.result for r in remote.cached_results(files, root, "m", "ar", compute).collect()}
    assert every["f7.wav"] == "r2" and every["f19.wav"] == "r4" and len(every) == 21
    again = asked.value
    remote.cached_results(files, root, "m", "ar", compute).collect()
    assert n >= 5 and asked.value == again and len(remote.ResultCache(spark, root, files.schema["path"].dataType).generations()) <= 2


def test_tools(spark, tmp_path, capsys):
    rows = [("1", "pain one two three", "a", "u", "", "dev", "g", "s"), ("2", "pain one two three", "b", "u", "", "test", "g", "s"), ("3", "other", "", "", "", "", "", "s")]
    path = write(tmp_path / "c.csv", COLUMNS[:-1], rows)
    assert tools.main(["checks", path]) == 1
    out = capsys.readouterr().out
    assert "n_rows: 3" in out and "cross-split exact duplicates: 1" in out and "cross-split group ids       : 1" in out
    assert tools.main(["checks", write(tmp_path / "d.csv", ["text", "split"], [("a b", "dev"), ("c d", "test")])]) == 0
    assert tools.main(["sheet", path, "--out", str(tmp_path / "s.csv"), "--n", "5"]) == 0
    with open(tmp_path / "s.csv", encoding="utf-8-sig", newline="") as f:
        sheet = list(csv.DictReader(f))
    assert [r["id"] for r in sheet] == ["C0001", "C0002"] and "wrote 2 unique texts" in capsys.readouterr().out
    for r, (a, b) in zip(sheet, (("x", "y"), ("x", "x")), strict=True):
        r |= {"label_a": a, "label_b": b, "urgency_a": "u", "urgency_b": "u"}
    done = write(tmp_path / "t.csv", list(sheet[0]), [list(r.values()) for r in sheet])
    assert tools.main(["agreement", done, "--disagreements", str(tmp_path / "todo.csv")]) == 0
    out = capsys.readouterr().out
    assert "label    n=   2  agreement=50.0%" in out and "cases needing adjudication: 1" in out
    with open(tmp_path / "todo.csv", encoding="utf-8-sig", newline="") as f:
        assert [r["label_b"] for r in csv.DictReader(f)] == ["y"]
