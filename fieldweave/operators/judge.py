"""The judge: whether a candidate means the same, from rules, responses or an endpoint.

Rows carry the candidate with ``s_name, t_name, s_desc, t_desc`` (lower case) where a rule
needs them. Every verdict is a struct (match, confidence, reason, llm_response, fallback,
parse_error, is_error, error_msg); rules and parsers are columns, so judging offline is
part of the plan. Only ``HttpJudge`` leaves the JVM, once for each distinct candidate key.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.formats import two_decimals
from ..sources.dictionary import first_of_name
from ..streaming.rate_control import Rule, is_throttled, step

VERDICT = "match boolean, confidence double, reason string, llm_response string, fallback boolean, parse_error boolean, is_error boolean, error_msg string"
KEY = ["source_table", "source_field", "target_table", "target_field"]


def verdict(match: Column, confidence: Column, reason: Column, response: Column | None = None, fallback: bool = False, parse_error: bool = False, error: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        match.cast("boolean").alias("match"), confidence.cast("double").alias("confidence"), reason.alias("reason"),
        (nothing if response is None else response).alias("llm_response"), F.lit(fallback).alias("fallback"), F.lit(parse_error).alias("parse_error"),
        (F.lit(False) if error is None else error.isNotNull()).alias("is_error"), (nothing if error is None else error).alias("error_msg"),
    )


def _when(*cases: tuple[Column, bool, Column]) -> tuple[Column, Column]:
    """(match, confidence) of the first case that holds; the last case's test is ignored."""
    *first, (_, match, confidence) = cases
    m, c = F.lit(match), confidence
    for test, yes, value in reversed(first):
        m, c = F.when(test, F.lit(yes)).otherwise(m), F.when(test, value).otherwise(c)
    return m, c


def _shares(groups: dict[str, list[str]]) -> Column:
    """Some group has a word in the name or description of both sides."""
    out = F.lit(False)
    for words in groups.values():
        sides = []
        for name, desc in (("s_name", "s_desc"), ("t_name", "t_desc")):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.col(name).contains(w) | F.col(desc).contains(w)
            sides.append(hit)
        out = out | (sides[0] & sides[1])
    return out


def _contained() -> Column:
    def of(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (a.contains(b) | b.contains(a))

    return of(F.col("s_name"), F.col("t_name")) | of(F.col("s_desc"), F.col("t_desc"))


def _same_name() -> Column:
    return F.col("s_name") == F.col("t_name")


def fallback(variant: str, aggressive: bool = True, threshold: float = 0.8, error: Column | None = None) -> Column:
    """The verdict of a rule on names and similarity, for when no response is to be had."""
    sim, cap = F.col("similarity"), lambda most, x: F.least(F.lit(most), x)
    always, said = F.lit(True), two_decimals(F.col("similarity"))
    if variant == "fixed":
        m, c = _when((_same_name(), True, F.lit(0.95)), (sim > 0.8, True, F.lit(0.8)), (sim > 0.6, True, F.lit(0.7)), (always, False, sim))
        reason = F.concat(F.lit("LLM调用失败，基于相似度"), said, F.lit("的回退判断。错误："), F.substring(F.coalesce(error, F.lit("")) if error is not None else F.lit(""), 1, 100))
    elif variant == "enhanced":
        lenient = (sim >= 0.4) & F.lit(aggressive)
        m, c = _when((_same_name(), True, F.lit(0.95)), (sim >= 0.8, True, F.lit(0.8)), (sim >= 0.6, True, F.lit(0.7)), (lenient, True, F.lit(0.6)), (always, False, sim))
        reason = F.concat(F.lit("LLM调用失败，基于相似度"), said, F.lit("的增强回退判断。错误："), F.substring(F.coalesce(error, F.lit("")) if error is not None else F.lit(""), 1, 100))
    elif variant == "robust":
        m, c = _when(
            (_same_name(), True, F.lit(0.95)), ((sim >= 0.8) & _shares(V.ROBUST_CONCEPTS), True, cap(0.85, sim + 0.1)),
            (sim >= 0.6, True, cap(0.75, sim + 0.05)), ((sim >= 0.4) & _contained(), True, cap(0.7, sim + 0.1)), (always, False, sim * 0.8),
        )
        reason = (
            F.when(_same_name(), F.lit("字段名完全匹配 (回退策略)"))
            .when((sim >= 0.8) & _shares(V.ROBUST_CONCEPTS), F.concat(F.lit("高相似度("), said, F.lit(")+业务概念匹配 (回退策略)")))
            .when(sim >= 0.6, F.concat(F.lit("中等相似度匹配("), said, F.lit(") (回退策略)")))
            .when((sim >= 0.4) & _contained(), F.concat(F.lit("字段包含关系+相似度("), said, F.lit(") (回退策略)")))
            .otherwise(F.concat(F.lit("相似度较低("), said, F.lit(")，判断为不匹配 (回退策略)")))
        )
    elif variant == "similarity":
        if aggressive:
            m, c = _when((sim >= 0.5, True, cap(0.8, sim + 0.2)), (sim >= 0.3, True, cap(0.7, sim + 0.3)), (always, False, sim))
        else:
            m, c = _when((sim >= 0.7, True, sim), (always, False, sim))
        reason = F.concat(F.lit("基于相似度"), said, F.lit("的增强回退策略。"))
    elif variant == "ultra":
        m, c = _when(
            (_same_name(), True, F.lit(0.95)), ((sim >= 0.8) & _shares(V.ULTRA_CONCEPTS), True, cap(0.85, sim + 0.05)), (sim >= 0.8, True, cap(0.8, sim)),
            (sim >= 0.6, True, cap(0.75, sim + 0.05)), ((sim >= 0.4) & _contained(), True, cap(0.7, sim + 0.1)), (always, False, sim),
        )
        reason = (
            F.when(_same_name(), F.lit("字段名完全匹配 (智能回退)"))
            .when((sim >= 0.8) & _shares(V.ULTRA_CONCEPTS), F.concat(F.lit("高相似度("), said, F.lit(")+业务概念匹配 (智能回退)")))
            .when(sim >= 0.8, F.concat(F.lit("高相似度("), said, F.lit(")匹配 (智能回退)")))
            .when(sim >= 0.6, F.concat(F.lit("中等相似度("), said, F.lit(")匹配 (智能回退)")))
            .when((sim >= 0.4) & _contained(), F.concat(F.lit("字段包含关系+相似度("), said, F.lit(") (智能回退)")))
            .when(sim >= 0.4, F.concat(F.lit("相似度较低("), said, F.lit(")，判断为不匹配 (智能回退)")))
            .otherwise(F.concat(F.lit("相似度过低("), said, F.lit(")，判断为不匹配 (智能回退)")))
        )
    elif variant == "pipeline":
        m, c = sim > threshold, sim
        reason = F.concat(F.lit("基于相似度 "), F.format_number(sim, 4))
    elif variant == "pipeline_aggressive":
        m, c = sim > F.when(sim > 0.8, F.lit(0.6)).otherwise(F.lit(0.4)), cap(0.8, sim + 0.1)
        reason = F.concat(F.lit("基于相似度 "), F.format_number(sim, 4))
    else:
        raise ValueError(f"no fallback {variant!r}")
    return verdict(m, c, reason, fallback=True, error=error)


def _first_number(response: Column, names: tuple[str, ...]) -> Column:
    """The first of the label's spellings that is followed by a number; 0 if none is."""
    tries = [_number(response, f"{n}{sep}([0-9.]+)") for n in names for sep in ("：", ":", ": ")]
    if len(names) > 1:  # the second label lists its plain colon first
        tries = tries[:3] + [tries[4], tries[3], tries[5]]
    return F.coalesce(*tries, F.lit(0.0))


def _number(response: Column, pattern: str) -> Column:
    return F.regexp_extract(response, pattern, 1).try_cast("double")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first_reason(response: Column, patterns: list[str]) -> Column:
    """What the first matching pattern captures, stripped; '' if none matches."""
    return F.coalesce(*[F.when(response.rlike(p), _stripped(F.regexp_extract(response, p, 1))) for p in patterns], F.lit(""))


def _says_yes(response: Column, labels: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for label in labels:
        for sep in ("：", ":", ": "):
            out = out | response.contains(f"{label}{sep}是")
    return out


_LINE = [f"理由{sep}([^\n]*?)(?=\n|$)" for sep in ("：", ":", ": ")]


def parse(variant: str, response: Column, similarity: Column, aggressive: bool = True, lenient: bool = True) -> Column:
    """A response's verdict. 'base' takes two languages and keeps an error text as a no;
    'strict' fills a missing confidence from the similarity; 'lenient' also takes positive
    words anywhere (only if ``lenient``), clamps, and lifts a doubtful yes."""
    zero = F.lit(0.0)
    if variant == "base":
        failed = response.startswith("错误：")
        match = _says_yes(response, ("判断",))
        found = _first_number(response, ("置信度", "confidence"))
        confidence = F.when(match & (found < 0.1), F.lit(0.8)).otherwise(found)
        labels = ["理由：", "理由:", "理由: ", "reason:", "reason：", "reason: "]
        reason = _first_reason(response, [rf"(?s){x}(.*?)(?=$|\n\n)" for x in labels])
        reason = F.when(reason == "", response).otherwise(reason)
        return verdict(match & ~failed, F.when(failed, zero).otherwise(confidence), F.when(failed, response).otherwise(reason))
    found = _first_number(response, ("置信度",))
    reason = _first_reason(response, _LINE)
    if variant == "strict":
        match = _says_yes(response, ("判断",))
        guess = F.when(match, F.greatest(F.lit(0.7), similarity + 0.1)).otherwise(F.least(F.lit(0.4), similarity))
        short = F.when(F.length(response) > 100, F.concat(F.substring(response, 1, 100), F.lit("..."))).otherwise(response)
        return verdict(match, F.when(found == 0, guess).otherwise(found), F.when(reason == "", short).otherwise(reason), response)
    if variant == "lenient":
        match = _says_yes(response, ("判断", "结论"))
        if lenient:
            match = match | response.rlike("匹配|等价|相同|一致|对应|相似")
        guess = F.when(match, F.greatest(F.lit(0.7), similarity + 0.2)).otherwise(F.greatest(F.lit(0.3), similarity))
        c = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.when(found == 0, guess).otherwise(found)))
        c = F.when(match & (c < 0.5) & F.lit(aggressive), F.greatest(F.lit(0.6), c + 0.2)).otherwise(c)
        return verdict(match, c, F.substring(F.when(reason == "", response).otherwise(reason), 1, 200), response)
    raise ValueError(f"no parser {variant!r}")


def unread(similarity: Column, message: Column) -> Column:
    """The verdict on a response that cannot be parsed."""
    return verdict(similarity > 0.6, similarity, F.concat(F.lit("解析LLM响应失败: "), message, F.lit("，基于相似度判断")), parse_error=True)


def failed(message: Column) -> Column:
    """The verdict on a candidate whose judging raised, or whose field is in no dictionary."""
    return verdict(F.lit(False), F.lit(0.0), F.concat(F.lit("处理失败: "), message), error=message)


def layer(similarity: Column) -> Column:
    return F.when(similarity >= 0.7, "high").when(similarity >= 0.4, "medium").otherwise("low")


def layer_rank(similarity: Column) -> Column:
    return F.when(similarity >= 0.7, 0).when(similarity >= 0.4, 1).otherwise(2)


def cache_key(variant: str = "base") -> Column:
    """A candidate's key: tables and fields, after a prefix of the variant; the table-less
    variant has the fields and three decimals of the similarity."""
    if variant == "fields":
        return F.concat_ws("_", "source_field", "target_field", F.format_number("similarity", 3))
    prefix = {"base": [], "fixed": [F.lit("fixed")], "robust": [F.lit("robust")], "enhanced": [F.lit("enhanced")]}[variant]
    return F.concat_ws("_", *prefix, "source_table", "source_field", "target_table", "target_field")


def prompt(variant: str = "short") -> Column:
    """The question put to a model; rows have table and field names, descriptions and types."""
    field = lambda side, x: F.concat(F.lit(f"{x}字段: "), F.col(f"{side}_field"), F.lit("，描述: "), F.coalesce(f"{side}_field_desc", F.lit("无描述")), F.lit("，类型: "), F.coalesce(f"{side}_field_type", F.lit("(未知)")))
    table = lambda side, x: F.concat(F.lit(f"{x}表: "), F.col(f"{side}_table"), F.lit("，描述: "), F.coalesce(f"{side}_table_desc", F.lit("(无)")))
    answer = F.lit("请按以下格式回答：\n判断：是或否\n置信度：0到1的小数\n理由：一句话")
    both = [field("source", "源"), field("target", "目标")]
    if variant == "short":
        return F.concat_ws("\n", F.lit("判断两个数据库字段是否语义等价。"), *both, answer)
    if variant == "long":
        return F.concat_ws("\n", F.lit("你是数据库模式匹配专家，判断两个字段是否语义等价。"), table("source", "源"), *both, table("target", "目标"), answer)
    if variant == "adaptive":
        sim = F.col("similarity")
        lead = (
            F.when(sim >= 0.7, F.lit("这两个字段特征相似度很高，请确认是否语义等价。"))
            .when(sim >= 0.4, F.lit("这两个字段特征相似度中等，请仔细判断是否语义等价。"))
            .otherwise(F.lit("这两个字段特征相似度较低，请考虑缩写和拼音后判断是否语义等价。"))
        )
        return F.concat_ws("\n", lead, *both, answer)
    raise ValueError(f"no prompt {variant!r}")


#: What a status means, and seconds that the variants' clients wait for an answer.
STATUS = {401: "API密钥无效", 403: "访问被拒绝", 429: "请求频率过高", 500: "服务器内部错误", 502: "网关错误", 503: "服务不可用"}
TIMEOUT_S = {"base": 60.0, "fixed": 60.0, "robust": 120.0, "enhanced": 60.0, "direct": 30.0, "ultra": 45.0}
#: Answers that another attempt cannot change.
FINAL = tuple(f"错误：{code} " for code in (400, 401, 403, 404))


def status_message(status: Column) -> Column:
    other = F.concat(F.lit("HTTP错误 "), status.cast("string"))
    return F.coalesce(*[F.when(status == code, F.lit(text)) for code, text in STATUS.items()], other)


def content(body: Column) -> Column:
    """The answer's text in a chat completion's JSON; null if it has none."""
    text = F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.choices[0].text"))
    return F.when(F.length(F.trim(text)) > 0, text)


def with_fields(found: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Candidates with both fields' descriptions and types, null where a dictionary has no
    such field; of repeated field names the first counts."""
    out = found
    for side, fields in (("source", source), ("target", target)):
        dim = first_of_name(fields.select("table_name", "name", "field_ord", "desc", "type", "table_desc")).select(
            F.col("table_name").alias(f"{side}_table"), F.col("name").alias(f"{side}_field"),
            F.col("desc").alias(f"{side}_field_desc"), F.col("type").alias(f"{side}_field_type"), F.col("table_desc").alias(f"{side}_table_desc"),
        )
        out = out.join(dim, [f"{side}_table", f"{side}_field"], "left")
    return out


def with_names(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "s_name": F.lower("source_field"), "t_name": F.lower("target_field"),
        "s_desc": F.lower(F.coalesce("source_field_desc", F.lit(""))), "t_desc": F.lower(F.coalesce("target_field_desc", F.lit(""))),
    })


@dataclass(frozen=True)
class RuleJudge:
    """Offline: a fallback rule for every candidate."""

    variant: str = "fixed"
    aggressive: bool = True
    threshold: float = 0.8

    def judge(self, rows: DataFrame) -> DataFrame:
        rule = fallback(self.variant, self.aggressive, self.threshold)
        known = F.col("source_field_desc").isNotNull() & F.col("target_field_desc").isNotNull()
        lost = failed(F.lit("字段不在数据字典中"))
        named = with_names(rows).withColumn("v", F.when(known, rule).otherwise(lost))
        return named.select(*rows.columns, "v.*")


@dataclass(frozen=True)
class ResponseJudge:
    """Responses given as a table (KEY columns, response); none or an error text falls back."""

    responses: DataFrame
    parser: str = "strict"
    rule: str = "fixed"
    aggressive: bool = True

    def judge(self, rows: DataFrame) -> DataFrame:
        answered = with_names(rows.join(self.responses.select(*KEY, F.col("response").alias("_response")), KEY, "left"))
        text = F.col("_response")
        bad = text.isNull() | text.startswith("错误：")
        parsed = parse(self.parser, F.coalesce(text, F.lit("")), F.col("similarity"), self.aggressive)
        missing = fallback(self.rule, self.aggressive, error=F.coalesce(text, F.lit("无响应")))
        v = F.when(bad, missing).otherwise(parsed) if self.parser != "base" else F.when(text.isNull(), missing).otherwise(parsed)
        return answered.withColumn("v", v).select(*rows.columns, "v.*")


def retry_delays(attempts: int = 3, base: float = 2.0) -> list[float]:
    """Seconds before each repeated attempt, without the random part."""
    return [base * 2 ** (n - 1) for n in range(1, attempts + 1)]


@dataclass(frozen=True)
class HttpJudge:
    """An OpenAI-compatible endpoint. ``send`` (prompt to response text) can be replaced, as
    tests do. Distinct keys are asked once, in ``clients`` tasks; the answers should be
    written before the plan branches, as a task that runs again asks again.

    Calls are ``min_interval_s`` apart, or, with a ``rule_of_delay``, as far as the adaptive
    rule says after each answer; its waits then stand before repeated attempts. An answer
    that no attempt can change (a refused key, a malformed request) is not asked for again."""

    url: str = ""
    api_key: str = ""
    model: str = ""
    temperature: float = 0.1
    max_tokens: int = 1000
    timeout_s: float | None = None  # the rule's variant decides
    attempts: int = 3
    min_interval_s: float = 0.5
    clients: int = 1
    batch_size: int = 5
    prompt_variant: str = "short"
    parser: str = "strict"
    rule: str = "fixed"
    send: Callable[[str], str] | None = None
    rule_of_delay: Rule | None = None

    def responses(self, rows: DataFrame) -> DataFrame:
        asked = rows.select(*KEY, prompt(self.prompt_variant).alias("prompt")).dropDuplicates(KEY)
        ask, size, adaptive = self.send or _sender(self), self.batch_size, self.rule_of_delay
        delays = list(adaptive.retries_s[: self.attempts]) if adaptive else retry_delays(self.attempts)
        first = adaptive.base_s if adaptive else self.min_interval_s

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, pause, streak = 0.0, first, 0
            for batch in batches:
                for at in range(0, len(batch), size):
                    part = batch.iloc[at : at + size]
                    answers = []
                    for text in part["prompt"]:
                        for delay in [0.0, *delays]:
                            time.sleep(max(0.0, last + pause - time.monotonic()) + (delay + random.random() if delay else 0.0))
                            last = time.monotonic()
                            answer = ask(text)
                            good = not answer.startswith("错误：")
                            if adaptive:
                                pause, streak = step(adaptive, pause, streak, good, not good and is_throttled(answer))
                            if good or answer.startswith(FINAL):
                                break
                        answers.append(answer)
                    yield part[KEY].assign(response=answers)

        return asked.repartition(self.clients, *KEY).mapInPandas(run, "source_table string, source_field string, target_table string, target_field string, response string")

    def judge(self, rows: DataFrame) -> DataFrame:
        return ResponseJudge(self.responses(rows), self.parser, self.rule).judge(rows)


def _sender(j: HttpJudge) -> Callable[[str], str]:
    url, key = f"{j.url.rstrip('/')}/chat/completions", j.api_key
    fixed = {"model": j.model, "temperature": j.temperature, "max_tokens": j.max_tokens}
    timeout = j.timeout_s or TIMEOUT_S.get(j.rule, TIMEOUT_S["base"])

    def send(text: str) -> str:
        body = json.dumps(fixed | {"messages": [{"role": "user", "content": text}]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                choice = json.load(response)["choices"][0]
            said = (choice.get("message") or {}).get("content") or choice.get("text") or ""
            return said if said.strip() else "错误：空响应"
        except urllib.error.HTTPError as e:
            return f"错误：{e.code} {STATUS.get(e.code, f'HTTP错误 {e.code}')}"
        except (OSError, ValueError, KeyError, IndexError) as e:
            return f"错误：{type(e).__name__}"

    return send


def judge_with_cache(rows: DataFrame, judge: RuleJudge | ResponseJudge | HttpJudge, cached: DataFrame | None, variant: str = "base") -> tuple[DataFrame, DataFrame]:
    """(all verdicts, new cache entries). Rows whose key is cached take the cached verdict;
    failures and rows without confidence are not cached."""
    keyed = rows.withColumn("cache_key", cache_key(variant))
    if cached is None:
        judged = judge.judge(keyed)
        hits = None
    else:
        entries = cached.select("cache_key", F.struct(*[c.split()[0] for c in VERDICT.split(", ")]).alias("v"))
        hits = keyed.join(entries, "cache_key").select(*keyed.columns, "v.*")
        judged = judge.judge(keyed.join(entries, "cache_key", "left_anti").select(keyed.columns))
    names = [c.split()[0] for c in VERDICT.split(", ")]
    fresh = judged.where("NOT is_error AND NOT coalesce(fallback, false) AND confidence > 0").select("cache_key", *names).dropDuplicates(["cache_key"])
    out = judged.withColumn("cached", F.lit(False))
    return (out if hits is None else out.unionByName(hits.withColumn("cached", F.lit(True)))), fresh
