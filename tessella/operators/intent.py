"""Intent of questions (kind of filing, years, quarters) and traces of the stages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import domain as dm


def prune(x: Any) -> Any:
    """Without null values of dictionaries and null items of lists, at every depth."""
    if isinstance(x, dict):
        return {k: prune(v) for k, v in x.items() if v is not None}
    return [prune(v) for v in x if v is not None] if isinstance(x, list) else x


@dataclass
class Stage:
    name: str
    started: float
    seconds: float | None = None
    tokens: int | None = None
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class Trace:
    """Stages of one request with their durations and tokens."""

    stages: list[Stage] = field(default_factory=list)

    def begin(self, name: str) -> Stage:
        self.stages.append(Stage(name, time.monotonic()))
        return self.stages[-1]

    def end(self, stage: Stage, tokens: int | None = None, **details: Any) -> None:
        stage.seconds, stage.tokens = time.monotonic() - stage.started, tokens
        stage.details |= details

    def to_dict(self) -> dict[str, Any]:
        return prune({"stages": [asdict(s) for s in self.stages], "seconds": sum(s.seconds or 0 for s in self.stages), "tokens": sum(s.tokens or 0 for s in self.stages)})


@dataclass
class Intent:
    doc_type: str | None = None
    years: list[int] = field(default_factory=list)
    quarters: list[str] = field(default_factory=list)
    confidence: float = 0.0

    def to_dict(self) -> dict[str, Any]:
        return prune(asdict(self))


def intents(queries: DataFrame, text: str, current_year: int) -> DataFrame:
    """`queries` with doc_type (null if unknown), years, quarters and confidence by rules."""
    q = queries.withColumn("__p", dm.query_period(text, current_year)).withColumn("__c", dm.classify(text))
    kind = F.nullif(F.col("__c.doc_type"), F.lit("unknown"))
    return q.withColumns({"doc_type": kind, "years": F.col("__p.years"), "quarters": F.col("__p.quarters"), "confidence": F.col("__c.confidence")}).drop("__p", "__c")


def parse_answer(answer: str | None) -> Intent | None:
    """A model's JSON answer, {"search_filters": {"years": [...], "category": ...}}; None if it cannot be read."""
    try:
        text = answer or ""
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])["search_filters"]
        years = list(dict.fromkeys(int(y) for y in found.get("years") or []))
        kind = found.get("category")
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    kind = kind if kind in ("report", "notice") else None
    return Intent(kind, years, [], 0.9 if kind else 0.0)


def analyse(spark, question: str, current_year: int, model: Callable[[str], str | None] | None = None) -> tuple[Intent, Trace]:
    """The intent of one question: the model's answer if it is usable, else the rules."""
    trace = Trace()
    stage = trace.begin("intent")
    intent = parse_answer(model(question)) if model else None
    if intent is None:
        r = intents(spark.createDataFrame([(question,)], "q string"), "q", current_year).first()
        intent = Intent(r.doc_type, list(r.years), list(r.quarters), r.confidence)
        trace.end(stage, source="rules")
    else:
        trace.end(stage, source="model")
    return intent, trace
