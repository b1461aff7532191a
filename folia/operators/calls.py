"""Model calls as batch jobs. The model is a function that the caller gives."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.batches import BATCH, by_bytes
from folia.functions.text import call_error_classify, strip
from folia.operators.candidates import fanout, stated
from folia.operators.usage import with_limits

ROUNDS = 3
RETRIES, WAIT, MOST_WAIT = 3, 5.0, 60.0
CHARACTERS_A_TOKEN = 4  # for the tokens that a prompt is expected to take


class RateLimit(Exception):
    """Raised by a model function that should be called again later."""


class Window:
    """Lets through at most ``calls`` calls and ``tokens`` tokens in any stretch of ``per`` seconds; a call over all the tokens goes alone."""

    def __init__(self, calls: int, tokens: int, per: float = 60.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.tokens, self.per, self.now, self.sleep = calls, tokens, per, now, sleep
        self.past: deque[list[float]] = deque()

    def enter(self, expected: int) -> None:
        """Waits until one more call of so many tokens fits, and counts it."""
        while True:
            at = self.now()
            while self.past and self.past[0][0] <= at - self.per:
                self.past.popleft()
            if not self.past or (len(self.past) < self.calls and sum(t for _, t in self.past) + expected <= self.tokens):
                self.past.append([at, expected])
                return
            self.sleep(max(self.past[0][0] + self.per - at, 0.001))

    def used(self, tokens: int) -> None:
        """Corrects the last call's tokens to what it really took."""
        self.past[-1][1] = tokens


def _called(fn: Callable[..., dict], arguments: tuple, retries: int, wait: float, window: Window | None) -> dict:
    for attempt in range(retries):
        try:
            if window:
                window.enter(len(str(arguments[0])) // CHARACTERS_A_TOKEN + 1)
            answer = {"error": None} | fn(*arguments)
            if window and (took := (answer.get("prompt_tokens") or 0) + (answer.get("completion_tokens") or 0)):
                window.used(took)
            return answer
        except RateLimit as e:
            if attempt == retries - 1:
                return {"error": f"429 {e}"}
            time.sleep(min(MOST_WAIT, wait * 2**attempt) * (1 + 0.1 * random.random()))
        except Exception as e:  # noqa: BLE001  a failed call is a row, not a failed job
            return {"error": str(e)}
    return {"error": "no attempt"}


def call_model(df: DataFrame, fn: Callable[..., dict] | None, partitions: int | None = None, retries: int = RETRIES, wait: float = WAIT, arguments: tuple[str, ...] = ("prompt",),
    client: Callable[[], Callable[..., dict]] | None = None, limited: bool = False, per: float = 60.0,
    roster: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """df (prompt) with text, finish_reason, prompt_tokens, completion_tokens, error_class.

    fn takes the argument columns and returns a dict with these keys; client makes one such function per partition, for what
    has to be opened once and cannot be sent. partitions bounds how many calls run at once, and each then takes its share of all rows;
    without it rows are called where they stand, so a task's rows do not grow with the input. Calls cost money and Spark evaluates
    lazily: write the result to a table before using it twice.

    limited: df has a column model, and its requests and tokens a minute (the table of quotas) hold over all partitions: a model's
    rows go to as many lanes as it has requests a minute, at most one a partition; a lane is in one task and keeps to its share of both.
    Calls that a lost task repeats are not in another task's count.

    roster: every row is called with every entry of this stated list, whose columns are arguments and come along; a prompt goes to Python
    once for all of them, unless a number of partitions spreads the calls. without: columns that the result does not need.
    """
    if limited and partitions is None:
        raise ValueError("quotas are shared over a stated number of partitions")
    by_bytes(df.sparkSession)
    names = ("text", "finish_reason", "prompt_tokens", "completion_tokens", "error")
    if roster is not None and partitions is not None:
        df, roster = fanout(df, roster), None
    entries = [{}] if roster is None else [r.asDict() for r in stated(roster).collect()]
    own = [f for f in df.schema if f.name not in without]
    added = [f for f in roster.schema if f.name not in without] if roster is not None else []
    columns = [f.name for f in own]

    def answers(batch: pd.DataFrame, of: list[int], by: list[dict], got: list[dict]) -> pd.DataFrame:
        out = batch[columns].iloc[of].reset_index(drop=True)
        out = out.assign(**{f.name: pd.Series([e[f.name] for e in by], dtype=object if f.dataType.typeName() == "string" else None) for f in added})
        return out.assign(**{n: pd.array([g.get(n) for g in got], dtype="Int64" if "tokens" in n else object) for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, windows = client() if client else fn, {}
        for batch in batches:
            of, by, got, size = [], [], [], 0
            for k in range(len(batch)):
                window = None
                if limited:
                    model, lane, lanes, rpm, tpm = (batch[c].iloc[k] for c in ("model", "_lane", "_lanes", "_rpm", "_tpm"))
                    if (model, lane) not in windows:
                        # Shares are whole and add up to the limit.
                        windows[model, lane] = Window(int(rpm // lanes + (lane < rpm % lanes)), int(tpm // lanes), per)
                    window = windows[model, lane]
                for e in entries:
                    got.append(_called(call, tuple(e[a] if a in e else batch[a].iloc[k] for a in arguments), retries, wait, window))
                    of.append(k)
                    by.append(e)
                    size += len(got[-1].get("text") or "")
                    if size > BATCH:
                        yield answers(batch, of, by, got)
                        of, by, got, size = [], [], [], 0
            if got:
                yield answers(batch, of, by, got)

    if limited:
        known = with_limits(df.select("*", F.struct("*").alias("_row"))).select("_row.*", F.col("rpm").alias("_rpm"), F.col("tpm").alias("_tpm"))
        known = known.withColumn("_lanes", F.least(F.lit(partitions), "_rpm")).withColumn("_lane", F.pmod(F.xxhash64(*arguments), F.col("_lanes")))
        dealt = known.repartition(partitions, "model", "_lane")
    else:
        dealt = df if partitions is None else df.repartition(partitions)
    schema = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*own, *added))
    out = dealt.mapInPandas(run, f"{schema}, text string, finish_reason string, prompt_tokens bigint, completion_tokens bigint, error string")
    return out.withColumn("error_class", call_error_classify(F.col("error"))).drop("error")


#: How a continuation is fenced.
FENCE_OPEN, FENCE_CLOSE = r"^```[a-zA-Z]*\n?", "```$"


def _unfenced(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(x), FENCE_OPEN, ""), FENCE_CLOSE, ""))


def stitch(chunks: DataFrame) -> DataFrame:
    """call_id, text, rounds of chunks (call_id, round, text, finish_reason): the first answer and up to three continuations, each only while the one before was cut off."""
    w = W.partitionBy("call_id").orderBy("round")
    cut_off = F.upper("finish_reason").contains("MAX_TOKENS") | F.lower("finish_reason").contains("length")
    ranked = chunks.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") <= ROUNDS)
    going = F.coalesce(F.min(cut_off.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1))
    kept = ranked.withColumn("_go", going).where("_go = 1").withColumn("_text", F.when(F.col("_k") == 0, F.col("text")).otherwise(_unfenced(F.col("text"))))
    full = kept.where((F.col("_k") == 0) | (F.coalesce("text", F.lit("")) != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_text"))), lambda x: x["_text"])
    return full.groupBy("call_id").agg(F.array_join(parts, "\n").alias("text"), F.count("*").alias("rounds"))


def chat_history(turns: DataFrame) -> DataFrame:
    """conv_id, messages: the turns in order; roles other than user and assistant count as user."""
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user")
    ordered = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def correct(cands: DataFrame, fn: Callable[[str], dict], judge: Callable[[DataFrame], DataFrame], prompt: Callable[[DataFrame], Column],
    keep: Callable[[DataFrame], DataFrame], max_rounds: int = ROUNDS, partitions: int | None = None) -> DataFrame:
    """Corrects invalid candidates in rounds.

    judge adds ``valid`` and ``errors`` to rows with ``xml``; prompt makes the prompt column; keep stores a round's rows
    (a written table, so that no call is made twice). A round works on what is still invalid only.
    """
    from folia.functions.text import corrected_xml_pick

    state = keep(judge(cands).withColumn("rounds", F.lit(0)))
    done = state.where("valid")
    for k in range(1, max_rounds + 1):
        todo = state.where("not valid")
        if todo.isEmpty():
            break
        asked = todo.withColumn("prompt", prompt(todo))
        answered = call_model(asked, fn, partitions)
        new = answered.withColumn("xml", F.coalesce(corrected_xml_pick(F.col("text")), "xml")).select(*cands.columns).withColumn("rounds", F.lit(k))
        state = keep(judge(new))
        done = done.unionByName(state.where("valid"))
    return done.unionByName(state.where("not valid"))
