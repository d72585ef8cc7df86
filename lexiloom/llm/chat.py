"""Operator 6: chat formatting in budgeted windows of whole turns.

A turn costs its white-space separated words and TURN_COST for its markers. Prefix
sums of the costs cut a conversation into windows of at most BUDGET: each begins
with the system turn, repeats the longest run of turns just before it that costs at
most HISTORY, and goes on with as many new turns as fit. Every turn is new in
exactly one window; only new assistant turns are targets, so a repeated answer is
never trained on twice.

Conversations are shuffled once by conv_id, sorted, and streamed: memory holds one
conversation at a time.

Result: (conv_id, window, first_turn, last_turn, n_repeated, cost, over_budget, text,
targets). first_turn and last_turn number the new turns from 0 in their order,
without the system turn. text is the turns as "<|role|>\\ncontent\\n"; targets lists
the code-point ranges of text to be trained on, as "from-to" joined by ";".

Defined cases: null conv_id: dropped. Turns are ordered by turn (nulls last), then
role, then text. Null role: "unknown"; null text: empty. The first turn of role
system is the system turn; later ones are ordinary turns. If the history leaves no
room for the first new turn, its oldest turns are left out. A turn that fits no
budget stays whole, alone with the system turn, and over_budget is true. A
conversation of a system turn alone has no windows. Repeated rows are turns like any
other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import arrow

BUDGET, HISTORY, TURN_COST = 512, 128, 4
_WORD = re.compile(r"[^ \t\n\r]+")
FIELDS = (
    ("conv_id", "bigint"), ("window", "bigint"), ("first_turn", "bigint"), ("last_turn", "bigint"), ("n_repeated", "bigint"),
    ("cost", "bigint"), ("over_budget", "boolean"), ("text", "string"), ("targets", "string"),
)


def windows(turns: list[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, turn_cost: int = TURN_COST) -> list[tuple]:
    """The rows of one conversation (without conv_id) from its (role, text) turns in order."""
    first = next((i for i, (role, _) in enumerate(turns) if role == "system"), None)
    system = [] if first is None else [turns[first]]
    rest = [t for i, t in enumerate(turns) if i != first]
    price = lambda t: len(_WORD.findall(t[1])) + turn_cost
    fixed = sum(map(price, system))
    sums = [0]
    for t in rest:
        sums.append(sums[-1] + price(t))
    out, at = [], 0
    while at < len(rest):
        room = min(history, budget - fixed - (sums[at + 1] - sums[at]))
        back = min(at, bisect_left(sums, sums[at] - room)) if room > 0 else at
        end = max(at + 1, bisect_right(sums, budget - fixed + sums[back]) - 1)
        parts, targets, size = [], [], 0
        for i, (role, text) in [(-1, t) for t in system] + [(i, rest[i]) for i in range(back, end)]:
            head = f"<|{role}|>\n"
            if i >= at and role == "assistant":
                targets.append(f"{size + len(head)}-{size + len(head) + len(text)}")
            parts.append(f"{head}{text}\n")
            size += len(parts[-1])
        cost = fixed + sums[end] - sums[back]
        out.append((len(out), at, end - 1, at - back, cost, cost > budget, "".join(parts), ";".join(targets)))
        at = end
    return out


def _runner(budget: int, history: int, turn_cost: int):
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], types[t]) for j, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, rows = None, [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    rows += [(now, *w) for w in windows(turns, budget, history, turn_cost)]
                    now, turns = conv, []
                turns.append((role, text))
            if len(rows) > 2000:
                yield pack(rows)
                rows = []
        rows += [(now, *w) for w in windows(turns, budget, history, turn_cost)]
        yield pack(rows)

    return run


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, turn_cost: int = TURN_COST) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("c"),
        F.coalesce("role", F.lit("unknown")).alias("r"),
        F.coalesce("text", F.lit("")).alias("x"),
        F.col("turn").cast("bigint").alias("t"),
    ).where("c is not null")
    turns = turns.repartition("c").sortWithinPartitions("c", F.col("t").asc_nulls_last(), "r", "x").select("c", "r", "x")
    return arrow(turns, _runner(budget, history, turn_cost), ", ".join(f"{n} {t}" for n, t in FIELDS))


ORACLE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), priced AS (
  SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) + {TURN_COST} AS price,
         row_number() OVER (PARTITION BY conv_id, role ORDER BY n) = 1 AND role = 'system' AS sys
  FROM turns
), fixed AS (
  SELECT conv_id, coalesce(sum(price) FILTER (WHERE sys), 0) AS fixed,
         coalesce(max('<|system|>' || chr(10) || text || chr(10)) FILTER (WHERE sys), '') AS head FROM priced GROUP BY conv_id
), rest AS (
  SELECT conv_id, role, text, price, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS i,
         sum(price) OVER (PARTITION BY conv_id ORDER BY n) AS upto
  FROM priced WHERE NOT sys
), spans AS (
  SELECT a.conv_id, a.i, f.fixed, f.head,
         (SELECT min(b.i) FROM rest b WHERE b.conv_id = a.conv_id AND (b.i = a.i OR (b.i < a.i
            AND (a.upto - a.price) - (b.upto - b.price) <= least({HISTORY}, {BUDGET} - f.fixed - a.price)))) AS back
  FROM rest a JOIN fixed f USING (conv_id)
), ends AS (
  SELECT s.*, (SELECT max(e.i) FROM rest e, rest k WHERE e.conv_id = s.conv_id AND k.conv_id = s.conv_id AND k.i = s.back
                 AND (e.i = s.i OR (e.i > s.i AND s.fixed + e.upto - (k.upto - k.price) <= {BUDGET}))) AS last
  FROM spans s
), walk AS (
  SELECT conv_id, i, back, last, fixed, head, 0 AS nth FROM ends WHERE i = 0
  UNION ALL
  SELECT e.conv_id, e.i, e.back, e.last, e.fixed, e.head, w.nth + 1 FROM walk w JOIN ends e ON e.conv_id = w.conv_id AND e.i = w.last + 1
), parts AS (
  SELECT w.conv_id, w.nth, w.i AS first, w.last, w.back, w.fixed, w.head, r.i, r.role, r.price, r.text,
         '<|' || r.role || '|>' || chr(10) || r.text || chr(10) AS part
  FROM walk w JOIN rest r ON r.conv_id = w.conv_id AND r.i BETWEEN w.back AND w.last
), placed AS (
  SELECT *, length(head) + sum(length(part)) OVER (PARTITION BY conv_id, nth ORDER BY i) - length(text) - 1 AS here FROM parts
)
SELECT conv_id, CAST(nth AS BIGINT) AS window, CAST(first AS BIGINT) AS first_turn, CAST(last AS BIGINT) AS last_turn,
       CAST(first - back AS BIGINT) AS n_repeated, CAST(fixed + sum(price) AS BIGINT) AS cost, fixed + sum(price) > {BUDGET} AS over_budget,
       head || string_agg(part, '' ORDER BY i) AS text,
       coalesce(string_agg(CAST(CAST(here AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(here + length(text) AS BIGINT) AS VARCHAR), ';' ORDER BY i)
                FILTER (WHERE role = 'assistant' AND i >= first), '') AS targets
FROM placed GROUP BY conv_id, nth, first, last, back, fixed, head
"""
