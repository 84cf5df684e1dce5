"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Rows are dealt by hash of conversation and stretch of
turns. A task cuts them into runs of at most RUN rows and hands a batch of runs to one recursive DuckDB query; each recursion
advances one turn of all runs and keeps, for each state of the grammar, the least cost and its audit. It does so from every
state in which a run may begin, so a run is a small matrix and a conversation of any length is the product of its runs' matrices.

Why the least audit may be kept at each step: two audits that reach a state at the same turn with the same cost never begin
one another, as a longer one would hold inserts more and cost more; so the order between them stays whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridex.session import Store

RUN = 256  # rows of a run, and turns of a stretch, at most
BATCH_ROWS, BATCH_BYTES = 1 << 15, 1 << 23  # of the runs that one query advances

# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row; what may follow each.
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}
#: Edits of a row: letter, state before, initial of the row (None: any), state after, cost.
_EDITS = [("K", "", "s", "s", 0), *(("K", s, t, t, 0) for s, t in _NEXT.items()), *(("R", s, None, t, REROLE) for s, t in _NEXT.items()), *(("D", s, None, s, DELETE) for s in _NEXT)]
#: Inserts between rows: state before, state after, letters, cost; more than two lead back to a state that was had for less.
_GAPS = [(s, s, "", 0) for s in _NEXT] + [(s, t, "I", INSERT) for s, t in _NEXT.items()] + [(s, _NEXT[t], "II", 2 * INSERT) for s, t in _NEXT.items() if _NEXT[t] != s]
_END = {s: (letters, cost) for s, t, letters, cost in sorted(_GAPS, key=lambda g: -g[3]) if t == "a" or s == t == ""}


def _values(rows: list[tuple]) -> str:
    say = lambda v: "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


_ADVANCE = f"""
with recursive edits(op, s, initial, t, w) as (values {_values(_EDITS)}), gaps(s, t, letters, w) as (values {_values(_GAPS)}),
best(run, entry, state, i, best) using key (run, entry, state) as (
  select run, s, s, 0, {{cost: 0::bigint, audit: ''}} from (select distinct run from rows), (select distinct s from edits)
  union
  select b.run, b.entry, e.t, b.i + 1, min({{cost: (b.best).cost + g.w + e.w + case when r.cut and e.op <> 'D' then {TRUNCATED} else 0 end, audit: (b.best).audit || g.letters || e.op}})
  from best b join rows r on r.run = b.run and r.i = b.i + 1 join gaps g on g.s = b.state
  join edits e on e.s = g.t and (e.op = 'D' or not r.gone) and (e.initial is null or e.initial = r.initial)
  group by b.run, b.entry, e.t, b.i)
select run, entry, state, (best).cost as cost, (best).audit as audit from best
"""


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that the test damage leaves, with nulls of role and text as one blank.

    By crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    c = conversations
    own = lambda name: F.coalesce(c[name].cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(own("conv_id"), F.lit(":"), own("turn")), "UTF-8")) % 20
    x = c.select(c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].cast("bigint").alias("turn"), own("role").alias("role"), own("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    x = x.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return x.drop("copy")


def _initial(role: str | Column) -> Column:
    return F.when(F.col(role) == "", " ").otherwise(F.substring(role, 1, 1))


def _flagged(rows: DataFrame, run: int) -> DataFrame:
    """rows by stretch and run, in order, with their first fault and what they add to the counts."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"), 256)
    keyed = rows.select("*", key.alias("key"))
    seen = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered")).where("k > 1").drop("k")
    x = keyed.join(seen, "key", "left").drop("key")
    later = F.col("first").isNotNull() & (F.col("unnumbered") & F.col("turn").isNotNull() | (F.col("turn") > F.col("first")))
    stretch = F.coalesce(F.floor(F.col("turn") / run), F.lit(-(2**62)))
    x = x.select("conv_id", stretch.alias("stretch"), "turn", "role", "text", F.coalesce(later, F.lit(False)).alias("later"))
    w = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = lambda c: F.lag(c).over(w)
    again = (F.col("i") > 1) & before("turn").eqNullSafe(F.col("turn")) & (before("role") == F.col("role")) & (before("text") == F.col("text"))
    x = x.withColumn("initial", _initial("role")).withColumn("i", F.row_number().over(w))
    fault = F.when(~F.col("text").rlike(_BLANK), "blank").when(F.col("later") | again, "duplicate").when(~F.col("text").rlike(_ENDED), "truncated").otherwise("")
    pair = F.concat(before("initial"), F.col("initial"))
    return x.select(
        "conv_id", "stretch", F.floor((F.col("i") - 1) / run).alias("part"), "turn", "role", "text", "initial", fault.alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), F.coalesce(F.col("turn").isNotNull() & ~before("turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("new_turn"))


_MATRIX = pa.list_(pa.struct([("entry", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_RUNS = ("conv_id bigint, stretch bigint, part bigint, lo bigint, hi bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
         "matrix array<struct<entry:string,state:string,cost:bigint,audit:string>>, alone_sha256 string")


class Replay:
    """The lines of a repaired conversation, given its audit, row by row; hashes them as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.hash = audit, 0, "", False, hashlib.sha256()

    def _line(self, state: str, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.state, self.any = state, True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            to = _NEXT[self.state]
            self._line(to, _ROLE[to], "")
            self.at += 1

    def row(self, initial: str, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(initial, role, text)
        elif edit == "R":
            to = _NEXT[self.state]
            self._line(to, _ROLE[to], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def finished(best: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) over the states in which a conversation may stand at its end, with the inserts that end it."""
    return min((cost + _END[s][1], audit + _END[s][0]) for s, (cost, audit) in best.items())


def _advance(con, t: pa.Table) -> pa.RecordBatch:
    """A row for each run of t, whose rows stand in order."""
    cols = {n: t.column(n).to_pylist() for n in t.column_names}
    same = lambda i, j: all(cols[n][i] == cols[n][j] for n in ("conv_id", "stretch", "part"))
    n, run, place, begins = t.num_rows, [], [], []
    for i in range(n):
        if not i or not same(i, i - 1):
            begins.append(i)
        run.append(len(begins) - 1)
        place.append(i - begins[-1] + 1)
    fault = cols["fault"]
    rows = pa.table({"run": pa.array(run, pa.int64()), "i": pa.array(place, pa.int64()), "initial": t.column("initial"),
                     "gone": pa.array([f in ("blank", "duplicate") for f in fault]), "cut": pa.array([f == "truncated" for f in fault])})
    con.register("rows", rows)
    matrix: list[list] = [[] for _ in begins]
    for k, entry, state, cost, audit in con.sql(_ADVANCE).fetchall():
        matrix[k].append({"entry": entry, "state": state, "cost": cost, "audit": audit})
    con.unregister("rows")
    out: dict[str, list] = {k: [] for k in ("conv_id", "stretch", "part", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "matrix", "alone_sha256")}
    for k, (i, j) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
        alone = Replay(finished({m["state"]: (m["cost"], m["audit"]) for m in matrix[k] if m["entry"] == ""})[1])
        for r in range(i, j):
            alone.row(cols["initial"][r], cols["role"][r], cols["text"][r])
        turns = [x for x in cols["turn"][i:j] if x is not None]
        got = (cols["conv_id"][i], cols["stretch"][i], cols["part"][i], min(turns, default=None), max(turns, default=None), sum(cols["new_turn"][i:j]),
               *(fault[i:j].count(f) for f in ("blank", "duplicate", "truncated")), sum(cols["illegal"][i:j]), cols["initial"][i], cols["initial"][j - 1], matrix[k], alone.digest())
        for c, v in zip(out.values(), got, strict=True):
            c.append(v)
    kind = lambda c: pa.string() if c in ("first", "last", "alone_sha256") else _MATRIX if c == "matrix" else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(v, kind(c)) for c, v in out.items()], names=list(out))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    held: pa.Table | None = None
    for b in batches:
        for i in range(0, len(b), RUN):
            piece = pa.Table.from_batches([b.slice(i, RUN)])
            held = piece if held is None else pa.concat_tables([held, piece])
            if held.num_rows < BATCH_ROWS and held.nbytes < BATCH_BYTES:
                continue
            ids = held.select(["conv_id", "stretch", "part"])
            last, cut = ids.slice(held.num_rows - 1).to_pylist(), held.num_rows - 1
            while cut and ids.slice(cut - 1, 1).to_pylist() == last:
                cut -= 1
            if cut:  # the last run may go on in the next batch
                yield _advance(con, held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield _advance(con, held)


_FOLDED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their runs, which come in order: the product of the runs' matrices, from the empty state on."""
    names = [c.split()[0] for c in _FOLDED.split(", ")]

    def done(c: dict) -> dict:
        cost, audit = finished(c["best"])
        gaps = c["hi"] - c["lo"] + 1 - c["turns"] if c["lo"] is not None else 0
        sha = c["sha"] if c["runs"] == 1 else hashlib.sha256().hexdigest() if not c["runs"] else None
        return {"conv_id": c["conv_id"], "gaps": gaps, **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": sha}

    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    now: dict | None = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(done(now))
                now = {"conv_id": r["conv_id"], "best": {"": (0, "")}, "runs": 0, "lo": None, "hi": None, "last": None, "sha": None} | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
            if r["matrix"] is None:
                continue
            best: dict[str, tuple[int, str]] = {}
            for m in r["matrix"]:
                if m["entry"] in now["best"]:
                    cost, audit = now["best"][m["entry"]]
                    new = (cost + m["cost"], audit + m["audit"])
                    best[m["state"]] = min(best.get(m["state"], new), new)
            for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                now[k] += r[k]
            now["illegal"] += int(now["last"] is not None and r["part"] == 0 and now["last"] + r["first"] not in ("su", "ua", "au"))
            now |= {"best": best, "runs": now["runs"] + 1, "last": r["last"], "sha": r["alone_sha256"]}
            if r["lo"] is not None:
                now |= {"lo": r["lo"] if now["lo"] is None else min(now["lo"], r["lo"]), "hi": r["hi"] if now["hi"] is None else max(now["hi"], r["hi"])}
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done(now)], schema)


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, repaired_sha256 of conversations whose audit comes first and whose rows follow in order."""
    schema, now, conv = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]), None, None
    for b in batches:
        out = []
        for c, audit, initial, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "audit", "initial", "role", "text")), strict=True):
            if audit is not None:
                if now:
                    out.append({"conv_id": conv, "repaired_sha256": now.digest()})
                now, conv = Replay(audit), c
            else:
                now.row(initial, role, text)
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": now.digest()}], schema)


def repair(rows: DataFrame, ids: DataFrame, store: Store, run: int = RUN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of `ids`.

    rows: conv_id, turn, role, text, taken by turn (nulls first), then by role and text, so that rows of one turn have an order of
    their own. A null conversation id is an id like any other; a null or empty role has a blank as its initial and so never stays
    under its own role; a null text is a blank. Repeated rows are duplicates. A conversation of `ids` without rows costs 0. Other columns are
    ignored; empty tables give an empty result. Edits: K keep, R rerole, D delete, I insert; the audit has a letter for each edit in order.

    A conversation of any length is cut into runs of at most `run` rows, which tasks advance independently; only its hash is made in order, in one
    task that holds one batch of its rows at a time.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    runs = _flagged(rows, run).mapInArrow(_runs, _RUNS)
    every = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    bare = every.select("conv_id", *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in runs.columns[1:]])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.unionByName(bare).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("stretch"), "part")
    folded = store.save(dealt.mapInArrow(_fold, _FOLDED), "folded")
    split = folded.where("repaired_sha256 is null")
    long = split.select("conv_id").alias("l")
    theirs = rows.alias("r").join(long, F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")), "left_semi")
    heads = split.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", F.lit("").alias("initial"))
    theirs = heads.unionByName(theirs.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), _initial("role").alias("initial")))
    theirs = theirs.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    again = theirs.mapInArrow(_rehash, "conv_id bigint, repaired_sha256 string")
    again = again.alias("a").join(split.alias("s"), F.col("a.conv_id").eqNullSafe(F.col("s.conv_id"))).select(*[F.col(f"{'a' if c == 'repaired_sha256' else 's'}.{c}") for c in folded.columns])
    return folded.where("repaired_sha256 is not null").unionByName(again)


#: The same in one recursive query over all rows; the checksum is made bit by bit, as there is no function for it.
REPAIR_SQL = r"""
with recursive bytes as (select list(v order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(b))),
said as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hit as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d from said, bytes),
dealt as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when d = 3 then [1, 2] else [1] end) as copy from hit where d <> 0),
placed as (select *, case when role = '' then ' ' else role[1] end as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from dealt),
l as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'none' end as fault, lag(c) over (partition by conv_id order by i) || c as pair from placed),
g(s, t) as (values ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
ids as (select distinct conv_id, coalesce(conv_id::varchar, ' ') as k from conversations),
size as (select coalesce(conv_id::varchar, ' ') as k, count(*) as n, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
  count_if(pair not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from l group by conv_id),
walk(k, i, s, best, done) as (
  select k, 0::bigint, '', {cost: 0::bigint, audit: '', said: ''}, false from ids
  union all
  select w.k, w.i + 1, x.t, min({cost: (w.best).cost + x.cost, audit: (w.best).audit || x.letters, said: (w.best).said || x.said}), coalesce(n, 0) = w.i
  from walk w left join size z on z.k = w.k left join l on coalesce(l.conv_id::varchar, ' ') = w.k and l.i = w.i + 1,
  lateral (select p.t0 as t0, p.letters, p.said, p.cost from (
      select w.s as t0, '' as letters, '' as said, 0 as cost
      union all select g.t, 'I', E'\n' || if(g.t = 'u', 'user:', 'assistant:'), 3 from g where g.s = w.s
      union all select h.t, 'II', E'\n' || if(g.t = 'u', 'user:', 'assistant:') || E'\n' || if(h.t = 'u', 'user:', 'assistant:'), 6 from g, g h where g.s = w.s and h.s = g.t) p) p,
  lateral (select p.t0 as t, p.letters, p.said, p.cost where l.i is null and p.t0 in ('', 'a')
      union all select p.t0, p.letters || 'D', p.said, p.cost + 4 where l.i is not null
      union all select g.t, p.letters || 'R', p.said || E'\n' || if(g.t = 'u', 'user:', 'assistant:') || l.text, p.cost + 3 + 3 * (l.fault = 'truncated')::int from g where g.s = p.t0 and l.fault in ('truncated', 'none')
      union all select l.c, p.letters || 'K', p.said || E'\n' || l.role || ':' || l.text, p.cost + 3 * (l.fault = 'truncated')::int
        where l.fault in ('truncated', 'none') and ((p.t0 = '' and l.c = 's') or exists (select 1 from g where g.s = p.t0 and g.t = l.c))) x
  where not w.done group by w.k, w.i, x.t, coalesce(n, 0) = w.i),
best as (select k, min(best) as b from walk where done group by k)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
(b).cost as cost, (b).audit as audit, sha256((b).said[2:]) as repaired_sha256 from ids join best using (k) left join size using (k)
"""
