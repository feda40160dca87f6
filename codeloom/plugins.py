"""Rules and policy packs from outside."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "payload_id bigint, path string, line int, rule_id string, severity string"


@dataclass(frozen=True)
class Rule:
    """UD-01, UD-02: ``run`` maps the corpus to rows of ``FINDING``."""

    id: str
    severity: str
    run: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def add(self, rule: Rule) -> None:
        if rule.id in self.rules:
            raise ValueError(f"rule {rule.id} is registered twice")
        self.rules[rule.id] = rule

    def load(self, path: str) -> None:
        """UD-03: a file that defines ``register_rules()``. What goes wrong is kept as an error; nothing of that file is then registered."""
        try:
            spec = importlib.util.spec_from_file_location(Path(path).stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            new = list(module.register_rules())
            if len({r.id for r in new} | set(self.rules)) < len(new) + len(self.rules):
                raise ValueError("a rule id is registered twice")
            for r in new:
                self.add(r)
        except Exception as e:  # a plugin may raise anything
            self.errors.append(f"{path}: {e}")

    def run(self, corpus: DataFrame) -> DataFrame:
        """All rules' findings, and a HIGH row for each plugin that couldn't be loaded."""
        spark = corpus.sparkSession
        out = spark.createDataFrame([(None, e, None, "Plugin loading", "HIGH") for e in self.errors], FINDING)
        for r in self.rules.values():
            out = out.unionByName(r.run(corpus).select(*[c.split()[0] for c in FINDING.split(", ")]))
        return out


def policy_pack(corpus: DataFrame, analyze_text: Callable[[str, str], list[tuple[str, int]]], name: str) -> DataFrame:
    """UD-04: ``analyze_text(path, text)`` gives ``(rule, line)`` pairs; run an Arrow batch at a time. A failure is a row of its own."""

    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(paths, texts, strict=True):
            try:
                out.append([{"rule_id": f"{name}.{r}", "line": int(n)} for r, n in analyze_text(p, t or "")])
            except Exception:  # a pack may raise anything
                out.append([{"rule_id": "PLUGINAPI002", "line": 1}])
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, "array<struct<rule_id:string,line:int>>")
    return corpus.select("payload_id", "path", F.inline(udf("path", "content"))).withColumn("severity", F.lit("MEDIUM"))
