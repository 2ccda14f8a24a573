"""Evidence, prompts, verdict parsing, and the verifier call: a rule verifier in Catalyst, or a client in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lines import merged
from siltstone.functions.normalize import strip
from siltstone.functions.scores import trace_lines
from siltstone.functions.text import code_lines, contains_any, excerpt, matching_lines, numbered, strip_fence

# Words looked for in code lines and prompts.
DANGEROUS = ("memcpy", "strcpy", "strcat", "sprintf", "gets", "scanf", "system", "free", "malloc", "realloc")
SOURCES = ("read", "recv", "scanf", "argv", "getenv", "input")
SINKS = ("memcpy", "strcpy", "strcat", "sprintf", "system", "free")
RISKY = ("memcpy", "strcpy", "strcat", "sprintf", "system", "free", "gets")
GUARDS = ("if (", "if(", "sizeof", "strncpy", "snprintf", "bounds", "assert")
SLACK = 0.05
#: Fields of the answer and what they hold.
ANSWER = {
    "sample_id": "the sample_id given above", "verdict": "vulnerable, benign or uncertain", "confidence": "number from 0 to 1",
    "predicted_cwe": "weakness id such as CWE-416, or empty", "vulnerable_lines": "array of line numbers from 1", "evidence": "array of objects",
    "need_more_context": "true or false", "missing_context": "array of strings", "patch_hint": "short text or empty",
}
SYSTEM = "You verify findings in C and C++ functions. Use only the code and the evidence given. Say vulnerable only if they show a concrete flaw, and uncertain if they do not suffice; then list what is missing. Answer with one JSON object and nothing else."
VERDICT = "sample_id string, verdict string, confidence double, predicted_cwe string, vulnerable_lines array<int>, evidence string, need_more_context boolean, missing_context array<string>, patch_hint string, success boolean, error string, prompt_tokens long, completion_tokens long, latency_seconds double"


@dataclass(frozen=True)
class VerifierConfig:
    """Settings of a verifier run; top_k None means all."""

    model: str = "mock-rule"
    top_k: int | None = 50
    max_retries: int = 3
    temperature: float = 0.0
    max_tokens: int = 1024
    concurrency: int = 8


_SHOWN = ("tool", "query_id", "message", "severity", "start_line", "end_line", "cwe")


def evidence_summary(features: DataFrame) -> DataFrame:
    """features (function_code, span, alerts, trace_lines, rank_score, perhaps graph_evidence as JSON) with summary: counts, alerts
    in short, line sets, excerpt and the graph evidence as it is ({} if there is none)."""
    lines = code_lines(F.col("function_code"))
    at = numbered(lines, F.col("span.start_line"))
    kind = features.schema["alerts"].dataType
    alerts, have = F.coalesce("alerts", F.array().cast(kind.simpleString())), kind.elementType.names
    short = F.transform(alerts, lambda a: F.struct(*[a[f].alias(f) for f in _SHOWN if f in have]))
    graph = F.coalesce(F.try_parse_json(F.col("graph_evidence")) if "graph_evidence" in features.columns else F.lit(None).cast("variant"), F.parse_json(F.lit("{}")))
    s = F.struct(
        "sample_id", F.size(alerts).alias("static_alert_count"), short.alias("alert_summaries"),
        merged(F.col("trace_lines"), trace_lines(F.col("alerts"))).alias("trace_lines"), matching_lines(at, DANGEROUS).alias("dangerous_api_lines"),
        matching_lines(at, SOURCES).alias("source_like_lines"), matching_lines(at, SINKS).alias("sink_like_lines"), "rank_score",
        F.col("span").alias("function_span"), excerpt(lines, F.col("function_code")).alias("code_excerpt"), graph.alias("graph_summary"),
    )
    return features.withColumn("summary", s)


def packet(summarised: DataFrame, language: Column | None = None) -> DataFrame:
    """Verification packets (PACKET and rank): code, span, alerts and graph evidence, the summary as context under its own key.

    A context column (map of text) that the rows have is kept beside the summary.
    """
    have = summarised.columns
    own = F.coalesce("context", F.create_map().cast("map<string,string>")) if "context" in have else F.create_map().cast("map<string,string>")
    lang = language if language is not None else F.coalesce("language", F.lit("c")) if "language" in have else F.lit("c")
    context = F.map_concat(F.map_filter(own, lambda k, _: k != "evidence_summary"), F.create_map(F.lit("evidence_summary"), F.to_json("summary", {"ignoreNullFields": "false"})))
    graph = F.coalesce("graph_evidence", F.lit("{}")) if "graph_evidence" in have else F.lit("{}")
    return summarised.select(
        "sample_id", lang.alias("language"), F.coalesce("function_code", F.lit("")).alias("function_code"), "span", F.coalesce("alerts", F.array().cast(summarised.schema["alerts"].dataType.simpleString())).alias("static_alerts"),
        graph.alias("graph_evidence"), context.alias("context"), *[c for c in ("rank",) if c in have],
    )


def prompt_of(packets: DataFrame) -> DataFrame:
    """(sample_id, system, prompt, and rank if the packets have it)."""
    head = F.concat(F.lit("sample_id: "), F.col("sample_id").cast("string"), F.lit("\nlanguage: "), "language", F.lit("\nspan: "), F.coalesce("span.file", F.lit("unknown")), F.lit(" "), F.col("span.start_line"), F.lit("-"), F.col("span.end_line"))
    body = F.concat(head, F.lit("\n\ncode:\n"), "function_code", F.lit("\n\nevidence:\n"), F.element_at("context", F.lit("evidence_summary")), F.lit("\n\nanswer with:\n" + json.dumps(ANSWER)))
    return packets.select("sample_id", F.lit(SYSTEM).alias("system"), body.alias("prompt"), *[c for c in ("rank",) if c in packets.columns])


def prompt(features: DataFrame, language: Column | None = None) -> DataFrame:
    """features with summary, as (sample_id, system, prompt)."""
    return prompt_of(packet(features, language)).select("sample_id", "system", "prompt")


def messages(prompts: DataFrame) -> DataFrame:
    """prompts with messages: array of (role, content), as a client takes them."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return prompts.withColumn("messages", F.array(one("system", "system"), one("user", "prompt")))


def rule_verdict(text: Column) -> Column:
    """A sink without a guard is vulnerable, with one uncertain, no sink benign; looked for in the whole prompt."""
    sink, guard = contains_any(text, RISKY, fold=False), contains_any(text, GUARDS, fold=False)
    return F.when(sink & ~guard, "vulnerable").when(sink, "uncertain").otherwise("benign")


def mock_verdicts(prompts: DataFrame, mode: str = "rule", text: str = "prompt") -> DataFrame:
    """Verdicts without any call, in Catalyst: a fixed one, or by rule. Tokens are characters divided by 4."""
    if mode not in ("vulnerable", "benign", "uncertain", "rule"):
        raise ValueError(f"unknown mode {mode!r}")
    v = rule_verdict(F.col(text)) if mode == "rule" else F.lit(mode)
    bad = F.col("verdict") == "vulnerable"
    return prompts.withColumn("verdict", v).select(
        "sample_id", "verdict", F.when(bad, 0.9).when(F.col("verdict") == "benign", 0.8).otherwise(0.5).alias("confidence"), F.when(bad, "CWE-119").otherwise("").alias("predicted_cwe"),
        F.when(bad, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("vulnerable_lines"), (F.col("verdict") == "uncertain").alias("need_more_context"), F.floor(F.length(text) / 4).alias("prompt_tokens"),
    )


def parse(raw: Column, expected: Column) -> Column:
    """struct(sample_id, verdict, confidence, predicted_cwe, vulnerable_lines, error) of an answer's text; error null if it is valid.

    A fence is stripped, an empty sample_id filled in, and a confidence up to 0.05 outside [0, 1] moved to its edge.
    """
    kind = "struct<sample_id:string,verdict:string,confidence:string,predicted_cwe:string,vulnerable_lines:array<double>>"
    text = strip_fence(raw)
    d = F.from_json(text, kind)
    number = d["confidence"].try_cast("double")
    fixed = F.when(number.between(-SLACK, 0.0), 0.0).when(number.between(1.0, 1.0 + SLACK), 1.0).otherwise(number)
    broken = F.try_parse_json(text).isNull() | ~strip(text).startswith("{")
    lines_ok = F.forall(F.coalesce(d["vulnerable_lines"], F.array().cast("array<double>")), lambda x: F.coalesce((x >= 1) & (x == F.floor(x)), F.lit(False)))
    error = F.when(raw.isNull() | broken, "json").when(number.isNull(), "confidence").when(~fixed.between(0, 1), "confidence range").when(~F.coalesce(d["verdict"].isin("vulnerable", "benign", "uncertain"), F.lit(False)), "verdict").when(~lines_ok, "vulnerable_lines")
    own = F.coalesce(F.nullif(d["sample_id"], F.lit("")), expected.cast("string"))
    return F.struct(own.alias("sample_id"), d["verdict"].alias("verdict"), fixed.alias("confidence"), F.coalesce(d["predicted_cwe"], F.lit("")).alias("predicted_cwe"), d["vulnerable_lines"].cast("array<int>").alias("vulnerable_lines"), error.alias("error"))


def read_answer(raw: object, sample_id: str) -> dict:
    """The checked verdict of an answer (text or object); raises ValueError if it is none."""
    if isinstance(raw, str):
        t = raw.strip()
        if t.startswith("```") and t.endswith("```") and len(t) >= 6:
            t = t[3:-3].strip()
            t = t[4:].strip() if t[:4].lower() == "json" else t
        raw = json.loads(t)
    if not isinstance(raw, dict):
        raise ValueError("the answer is not an object")
    d = dict(raw)
    d["sample_id"] = d.get("sample_id") or sample_id
    c = float(d["confidence"])
    if not -SLACK <= c <= 1 + SLACK:
        raise ValueError(f"confidence {c} is out of range")
    d["confidence"] = min(1.0, max(0.0, c))
    if d.get("verdict") not in ("vulnerable", "benign", "uncertain"):
        raise ValueError(f"unknown verdict {d.get('verdict')!r}")
    lines = d.get("vulnerable_lines") or []
    if any(not isinstance(x, int) or isinstance(x, bool) or x < 1 for x in lines):
        raise ValueError("vulnerable_lines must be whole numbers from 1")
    return d


class ChatError(RuntimeError):
    """A chat call failed for good; the text has no key in it."""


class ChatClient:
    """A client of an HTTP endpoint that takes chat messages as JSON; made in each task, so it holds no connection.

    Transport errors and the answers 429 and 500 to 599 are tried again, up to `attempts` times, after min(2 n, 10) seconds.
    The key comes from the argument or the environment and is in no message, log or error. send(url, headers, body, seconds)
    returns (status, body) and may be replaced in tests.
    """

    def __init__(self, url: str, model: str, key: str | None = None, key_name: str = "CHAT_API_KEY", temperature: float = 0.0, max_tokens: int = 1024, seconds: float = 60, attempts: int = 3, json_mode: bool = True, send: Callable | None = None, wait: Callable[[float], None] = time.sleep):
        self.key = key or os.environ.get(key_name)
        if not self.key:
            raise ChatError(f"no key: pass one or set {key_name}")
        self.url, self.seconds, self.attempts = f"{url.rstrip('/')}/chat/completions", seconds, attempts
        self.send, self.wait = send or _post, wait
        self.body = {"model": model, "temperature": temperature, "max_tokens": max_tokens} | ({"response_format": {"type": "json_object"}} if json_mode else {})

    def __call__(self, messages: list[dict]) -> tuple[object, int | None, int | None]:
        """(answer, prompt tokens, completion tokens)."""
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        last = "no attempt"
        for attempt in range(1, self.attempts + 1):
            try:
                status, raw = self.send(self.url, headers, json.dumps(self.body | {"messages": messages}).encode(), self.seconds)
            except OSError as e:
                last = f"{type(e).__name__}: {e}".replace(self.key, "***")
            else:
                if status == 200:
                    return self._answer(raw)
                if status != 429 and not 500 <= status <= 599:
                    raise ChatError(f"status {status}")
                last = f"status {status}"
            if attempt < self.attempts:
                self.wait(min(2.0 * attempt, 10.0))
        raise ChatError(f"failed {self.attempts} times, at last with {last}")

    @staticmethod
    def _answer(raw: bytes) -> tuple[object, int | None, int | None]:
        try:
            body = json.loads(raw)
            content = body["choices"][0]["message"]["content"]
            used = body.get("usage") or {}
            return content, used.get("prompt_tokens"), used.get("completion_tokens")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise ChatError("malformed answer of the endpoint") from e


def _post(url: str, headers: dict[str, str], body: bytes, seconds: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def chat_clients(url: str, config: VerifierConfig, key: str | None = None, **kw: object) -> Callable[[], ChatClient]:
    """A maker of clients for verify(), with the model, temperature and length of the config."""
    return lambda: ChatClient(url, config.model, key, temperature=config.temperature, max_tokens=config.max_tokens, **kw)


class Journaled:
    """A client that keeps each answer in a folder, by a hash of the model, its settings and the messages, and never asks the same again.

    A task that runs again (a lost executor, another evaluation, another run) finds what was answered before and asks only
    for the rest; two tasks that ask the same at the same time may both ask. The folder is anywhere that pyarrow can write.
    """

    def __init__(self, client: Callable, folder: str, config: VerifierConfig):
        from pyarrow import fs

        self.client, self.config, self.kinds = client, [config.model, config.temperature, config.max_tokens], fs.FileType
        self.fs, self.folder = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        self.fs.create_dir(self.folder, recursive=True)

    def __call__(self, messages: list[dict]) -> tuple[object, int | None, int | None]:
        key = hashlib.sha256(json.dumps([*self.config, messages], sort_keys=True).encode()).hexdigest()
        path = f"{self.folder}/{key}.json"
        if self.fs.get_file_info(path).type == self.kinds.File:
            with self.fs.open_input_stream(path) as f:
                return tuple(json.loads(f.read()))
        answer = self.client(messages)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(part, path)  # an answer is there as a whole or not at all
        return answer


def verify(prompts: DataFrame, make_client: Callable[[], Callable[[list[dict]], tuple[object, int | None, int | None]]], config: VerifierConfig | None = None, journal: str | None = None) -> DataFrame:
    """Verdicts of a client, called in Arrow batches; a client a task, `concurrency` tasks at a time.

    make_client() gives a function of messages that returns (answer, prompt tokens, completion tokens). Of prompts with a rank,
    the config's top_k are sent. An answer that does not parse is sent back for repair up to max_retries times, then the
    verdict is uncertain with confidence 0; so it is, without success, if the client fails. With a journal (a folder that all
    executors share) no question is asked again, however often the result is evaluated or a task is run; failures are not
    kept. Without one every evaluation calls again.
    """
    c = config or VerifierConfig()
    if c.top_k is not None and "rank" in prompts.columns:
        prompts = prompts.where(F.col("rank") <= c.top_k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client() if journal is None else Journaled(make_client(), journal, c)
        for b in batches:
            yield pd.DataFrame([_one(client, r.sample_id, r.system, r.prompt, c.max_retries) for r in b.itertuples()], columns=[x.split()[0] for x in VERDICT.split(", ")])

    return prompts.select(F.col("sample_id").cast("string"), "system", "prompt").repartition(c.concurrency).mapInPandas(run, VERDICT)


def _one(client: Callable, sample_id: str, system: str, text: str, retries: int) -> tuple:
    start, tokens, d, ok, error = time.perf_counter(), (None, None), None, True, None
    try:
        raw, *tokens = client([{"role": "system", "content": system}, {"role": "user", "content": text}])
        for attempt in range(retries + 1):
            try:
                d = read_answer(raw, sample_id)
                break
            except (ValueError, TypeError, KeyError) as e:
                error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    ask = f"The answer for sample_id {sample_id} was invalid: {error}\n\n{raw}\n\nAnswer with one JSON object with these fields: {json.dumps(ANSWER)}"
                    raw = client([{"role": "system", "content": "You repair JSON. Keep the judgement, fix the form."}, {"role": "user", "content": ask}])[0]
        reason = None if d else f"parse failure: {error}"
    except Exception as e:  # whatever a client raises must not lose the other rows
        ok, reason = False, f"client error: {type(e).__name__}"
    took = time.perf_counter() - start
    if d is None:
        return (sample_id, "uncertain", 0.0, "unknown", [], "[]", True, [reason], "", ok, reason, *tokens, took)
    return (d["sample_id"], d["verdict"], d["confidence"], d.get("predicted_cwe") or "", d.get("vulnerable_lines") or [], json.dumps(d.get("evidence") or []), bool(d.get("need_more_context")), list(d.get("missing_context") or []), d.get("patch_hint") or "", ok, None, *tokens, took)


def cost_log(verdicts: DataFrame, model: str) -> DataFrame:
    """Rows of the cost log; no prompts and no keys."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return verdicts.select("sample_id", F.lit(model).alias("model"), "prompt_tokens", "completion_tokens", total.alias("total_tokens"), "latency_seconds", "success", F.col("error").alias("error_type"))


def write_cost_log(verdicts: DataFrame, model: str, path: str | None, prices: tuple[float, float] | None = None) -> int:
    """Replaces the log at path by the rows of this run, with the cost if prices a million tokens are given; no path, no log."""
    if path is None:
        return 0
    from siltstone.operators.experiments import price
    from siltstone.sources.sinks import write_jsonl

    rows = cost_log(verdicts, model)
    return write_jsonl(price(rows, *prices) if prices else rows, path)
