"""Toxicity scores by weak supervision.

1. Voters. Words and word beginnings that stand out among rows annotated toxic become lexicon voters; a few patterns of
   the text (shouting, exclamation, symbols, shortness) are pattern voters. The annotation picks the lexicon and is no voter.
2. Label model. Over annotated rows and as many rows without annotation, expectation maximisation over the unknown true
   label estimates how often each voter is right when it speaks (its accuracy) and how voters speak together within each
   class (their correlations). Voters that speak together share their evidence. It starts from the rows where any lexicon
   voter speaks. The annotation gives accuracies to start from, worth a few calls, and is seen no more.
3. Classifier. A logistic regression over words, word beginnings and patterns is trained on the posterior labels, and
   scores every text in one pass, without a shuffle.

Features are counted in Spark; the driver gets the counts of at most FEATURES_MOST of them, and of the sampled rows
only the numbers of those that they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K

#: Annotated rows that the model is fitted on, at most, by hash of doc_id, and rows without annotation, at most: the two
#: bounded samples of this operator.
SAMPLE_MOST = 10_000
OTHERS_MOST = 10_000
VOTERS_MOST = 400
FEATURES_MOST = 4_000
THRESHOLD = 0.3
#: Correlations of two voters within the classes below this are taken for chance.
CORRELATED = 0.2
#: Calls that a voter's share of annotated toxic rows is worth beside what the label model finds.
TRUST = 30
HELD_MOD, HELD = 4, 2
#: Sampled rows, and marks of features, that the fit has in double precision at once: the driver holds little beside the votes.
ROWS_AT_ONCE, MARKS_AT_ONCE = 1_024, 1 << 18

#: Lower-case ASCII letters and all bytes of non-ASCII characters form words.
_APART = np.ones(256, bool)
_APART[97:123] = False
_APART[128:] = False
_BEGIN = (4, 5, 6)
PATTERNS = ("shouting", "exclaiming", "symbols", "short")
#: Feature numbers of the patterns; words are hashes, which do not fall on these small numbers.
_PATTERN_KEYS = np.arange(1, len(PATTERNS) + 1, dtype=K.U)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word and word beginning (repeats included). raw: lower-cased."""
    s, e, row = K.words(raw, off, _APART)
    rows, vals = [row], [K.hashes(raw, s, e, 1)]
    for k in _BEGIN:
        long = e - s > k
        rows.append(row[long])
        vals.append(K.hashes(raw, s[long], s[long] + k, 10 + k))
    return np.concatenate(rows), np.concatenate(vals)


def patterns(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x PATTERNS: capitals are more than half of a text's letters, over 1 % exclamation marks, less than 60 % letters, under 100 bytes."""
    upper, mark = (raw >= 65) & (raw <= 90), raw == 33
    letter = ~_APART[K.lower_ascii(raw)]
    upper, mark, letter = (np.diff(np.concatenate([[0], np.cumsum(x)])[off]) for x in (upper, mark, letter))
    n = np.diff(off)
    return np.stack([2 * upper > letter, mark > 0.01 * n, letter < 0.6 * n, n < 100], 1)


def _found(batch: pa.RecordBatch):
    """Chunks of rows: first row, last row, and each feature of a row once: rows and hashes, sorted."""
    raw0, off0 = K.utf8(batch.column("text"))
    for i, j, raw, off in _lowered(batch.column("text")):
        r, v = features(raw, off)
        said = patterns(raw0[off0[i] : off0[j]], off0[i : j + 1] - off0[i])
        pr, pk = np.nonzero(said)
        r, v = np.concatenate([r, pr]), np.concatenate([v, _PATTERN_KEYS[pk]])
        o = np.lexsort((v, r))
        r, v = r[o], v[o]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        yield i, j, r[new], v[new]


def _lowered(col: pa.Array):
    """Chunks of rows: first row, last row, lower-cased bytes, offsets."""
    _, off = K.utf8(col)
    for i, j in K.pieces(off):
        low = [(x or "").lower().encode("utf-8", "surrogatepass") for x in col.slice(i, j - i).to_pylist()]
        yield i, j, np.frombuffer(b"".join(low), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)


def _tally(batches):
    """Per task: each feature's rows and toxic rows among the annotated; a null feature counts all of them."""
    vs, ys, n, toxic = [], [], 0, 0
    for b in batches:
        y = b.column("toxic").to_numpy(zero_copy_only=False).astype(float)
        for i, j, r, v in _found(b):
            vs.append(v)
            ys.append(y[i:j][r] > 0)
        n, toxic = n + len(y), toxic + int((y > 0).sum())
    u, col = np.unique(np.concatenate(vs), return_inverse=True) if vs else (np.zeros(0, K.U), np.zeros(0, np.int64))
    df, pos = np.bincount(col, minlength=len(u)), np.bincount(col, weights=np.concatenate(ys) if ys else None, minlength=len(u)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(K.signed(u)), pa.nulls(1, pa.int64())]), pa.array(np.append(df, n)), pa.array(np.append(pos, toxic))], names=["v", "df", "pos"])


def _columns(chosen):
    """A row per sampled row: its annotation, and the numbers of the chosen features that it has."""

    def run(batches):
        keys = chosen.value
        for b in batches:
            for i, j, r, v in _found(b):
                k = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                hit = keys[k] == v
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(i, j - i), K.binary_column(k[hit].astype(np.uint16), np.bincount(r[hit], minlength=j - i))], names=["toxic", "cols"])

    return run


def label_model(votes: np.ndarray, lexicon: int, before: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, each voter's accuracy (the last is that of the voter for clean), and the voters' correlations.

    votes: rows x voters, 1 where a voter calls a row toxic, 0 where it abstains; the first `lexicon` are words. A further
    voter calls those rows clean where all words abstain. before: accuracies to start from, worth TRUST calls each. An accuracy is the share of a voter's calls that are right, by the
    posterior; the posterior follows from the accuracies of the voters that spoke. Of voters that spoke on a row, each shares
    its evidence with those among them that it is correlated with, by the correlations of their calls within the classes.
    """
    silent = ~votes[:, :lexicon].any(1)
    n, m = votes.shape
    parts = [slice(i, i + ROWS_AT_ONCE) for i in range(0, n, ROWS_AT_ONCE)]
    post, shared, calls = np.where(silent, 0.02, 0.9), np.empty_like(votes), votes.sum(0)
    for k in range(rounds):
        right = np.clip((sum(post[p] @ votes[p] for p in parts) + TRUST * before) / (calls + TRUST), 0.02, 0.995)
        clean = np.clip(((1 - post) @ silent + 1) / (silent.sum() + 2), 0.5, 0.999)
        prior = (post.sum() + 1) / (n + 2)
        if k % 10 == 0:
            cov = np.zeros((m, m))
            for share in (post, 1 - post):  # correlations are parameters of both classes
                mean = sum(share[p] @ votes[p] for p in parts) / max(1e-9, share.sum())
                for p in parts:
                    centred = (votes[p] - mean) * np.sqrt(share[p])[:, None]
                    cov += (centred.T @ centred) / n
            sd = np.sqrt(np.diag(cov)) + 1e-9
            rho = cov / np.outer(sd, sd)
            rho = np.where(rho > CORRELATED, np.minimum(rho, 1), 0).astype(np.float32)
            np.fill_diagonal(rho, 1)
            for p in parts:
                shared[p] = votes[p] / np.maximum(1, votes[p] @ rho)
        base = np.log(prior / (1 - prior))  # a voter's evidence is how far its accuracy moves the odds from here
        moves = np.log(right / (1 - right)) - base
        odds = base + np.concatenate([shared[p] @ moves for p in parts]) - silent * (np.log(clean / (1 - clean)) + base)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, np.append(right, clean), rho


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, y: np.ndarray, rounds: int = 400, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept over binary features, by full-batch Adagrad."""
    w, c = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gc = np.full(m, 1e-6), 1e-6
    parts = [(rows[i : i + MARKS_AT_ONCE], cols[i : i + MARKS_AT_ONCE]) for i in range(0, len(rows), MARKS_AT_ONCE)]
    for _ in range(rounds):
        z = sum((np.bincount(r, weights=w[k], minlength=n) for r, k in parts), np.full(n, c))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = sum((np.bincount(k, weights=d[r], minlength=m) for r, k in parts), l2 * w)
        h = d.sum()
        gw += g * g
        gc += h * h
        w -= 0.5 * g / np.sqrt(gw)
        c -= 0.1 * h / np.sqrt(gc)
    return w, c


def _constant(toxic: float, n: float) -> tuple[np.ndarray, np.ndarray, float]:
    return np.zeros(0, K.U), np.zeros(0), float(np.log(19)) if n and toxic == n else float(-np.log(19))


def fit(keys: np.ndarray, share: np.ndarray, lexicon: np.ndarray, sample: list) -> tuple[np.ndarray, float, dict]:
    """Weights of the features `keys` (sorted hashes), the intercept, and how the label model agrees with the annotation.

    share: each feature's share of toxic rows among the annotated; lexicon: the numbers of the features that vote beside the patterns. sample: rows of _columns.
    """
    lens = np.array([len(r.cols) // 2 for r in sample])
    col = np.frombuffer(b"".join(bytes(r.cols) for r in sample), np.uint16)
    row = np.repeat(np.arange(len(sample), dtype=np.int32), lens)
    voters = np.concatenate([lexicon, np.flatnonzero(np.isin(keys, _PATTERN_KEYS))])
    at = np.full(len(keys), -1, np.int16)
    at[voters] = np.arange(len(voters))
    votes = np.zeros((len(sample), len(voters)), np.float32)
    hit = at[col] >= 0
    votes[row[hit], at[col[hit]]] = 1
    del hit
    post, right, rho = label_model(votes, len(lexicon), share[voters])
    del votes
    known = np.array([r.toxic is not None for r in sample])
    y = np.array([r.toxic or 0 for r in sample]) > 0
    agree = {"voters": len(voters), "rows": len(sample), "annotated": int(known.sum()), "agreement": float(((post > 0.5) == y)[known].mean()), "recall": float((post > 0.5)[known & y].mean()), "accuracies": right, "correlations": rho}
    w, c = logistic(row, col, len(sample), len(keys), post)
    return w, c, agree


def _score(model):
    def run(batches):
        keys, weights, base = model.value
        seen = np.zeros(1 << 22, bool)
        seen[(keys & K.U((1 << 22) - 1)).astype(np.int64)] = True
        for b in batches:
            ids = b.column("doc_id")
            raw0, off0 = K.utf8(b.column("text"))
            for i, j, raw, off in _lowered(b.column("text")):
                r, v = features(raw, off)
                pr, pk = np.nonzero(patterns(raw0[off0[i] : off0[j]], off0[i : j + 1] - off0[i]))
                r, v = np.concatenate([r, pr]), np.concatenate([v, _PATTERN_KEYS[pk]])
                maybe = seen[(v & K.U((1 << 22) - 1)).astype(np.int64)]
                r, v = r[maybe], v[maybe]
                k = np.minimum(np.searchsorted(keys, v), max(0, len(keys) - 1))
                hit = keys[k] == v if len(keys) else np.zeros(len(v), bool)
                pair = np.unique(r[hit] * max(1, len(keys)) + k[hit])
                z = np.bincount(pair // max(1, len(keys)), weights=weights[pair % max(1, len(keys))] if len(keys) else None, minlength=j - i) + base
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return run


def held_out():
    """Whether a row is kept from learning: crc32 of its doc_id as text, mod 4, is 2; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_MOD == HELD


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights, and the intercept. Only texts and labels enter, none of a held-out row.

    Rows without doc_id teach nothing, nor do labels without a value; of labels that repeat a doc_id, the larger counts.
    Without any label, or with one class only, scores are constant.
    """
    spark = docs.sparkSession
    mine = docs.where("doc_id is not null").where(~held_out())
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(*by_hash).limit(SAMPLE_MOST)  # a bounded table, as the next one: both are broadcast
    others = mine.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct().orderBy(*by_hash).limit(OTHERS_MOST)
    picked = spark.createDataFrame([(r.doc_id, r.toxic) for r in known.unionByName(others.withColumn("toxic", F.lit(None).cast("int"))).collect()], "doc_id bigint, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    counts = rows.where("toxic is not null").mapInArrow(_tally, "v bigint, df bigint, pos bigint").groupBy("v").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    # What stands out: z measures how far the toxic rows of a feature are from their share among all annotated rows.
    whole = F.broadcast(counts.where("v is null").select(F.col("df").alias("n"), F.col("pos").alias("t")))
    counts = counts.where("v is not null and df >= 2").crossJoin(whole).withColumn("m", F.col("t") / F.col("n"))  # one row
    counts = counts.withColumn("z", F.expr("(pos - df * m) / sqrt(df * m * (1 - m) + 1)")).withColumn("share", F.expr("(pos + 0.05) / (df + 0.5)"))
    told = F.col("v").between(1, len(PATTERNS))
    top = counts.where(told | F.expr("z > 2.5 and share > 0.2 or z < -4")).orderBy(F.desc(told.cast("int")), F.desc(F.abs("z")), "v").limit(FEATURES_MOST).collect()
    if not top or top[0].t in (0, top[0].n):
        total = labels.where("toxic is not null and doc_id is not null").where(~held_out()).agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
        return _constant(total[1], total[0])
    v = np.array([r.v for r in top], np.int64).view(K.U)
    o = np.argsort(v)
    keys, pos, share, z = v[o], *(np.array([r[c] for r in top], float)[o] for c in ("pos", "share", "z"))
    lexicon = np.flatnonzero((pos >= 3) & (share > 0.88) & (z > 3) & ~np.isin(keys, _PATTERN_KEYS))
    lexicon = lexicon[np.argsort(-z[lexicon], kind="stable")][:VOTERS_MOST]
    if not len(lexicon):
        return _constant(float(top[0].t), 0.0)
    got = rows.mapInArrow(_columns(spark.sparkContext.broadcast(keys)), "toxic int, cols binary").collect()
    w, c, _ = fit(keys, share, lexicon, sorted(got, key=lambda r: (bytes(r.cols), r.toxic is None, r.toxic)))
    return keys, w, c


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; empty and null texts score the intercept.

    Repeated rows each get a row; more columns of either table are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for b in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column("text")], names=["doc_id", "text"])
            score = [x.column("score").to_numpy() for x in _score(model)([two])]
            if score:
                yield b.filter(pa.array(np.concatenate(score) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
