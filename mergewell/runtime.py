"""Session helpers shared by all operators."""

from __future__ import annotations

import itertools
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is made only where none is configured (tests)."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), "mergewell-checkpoints")
    sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_VIEWS = itertools.count()


def _closing(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``; quoted text is passed over."""
    depth, quote = 0, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
    raise ValueError("a parenthesis isn't closed")


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of a statement in which ``{name}`` stands for a table given by that name; other braces are left alone.

    The parts of a leading WITH clause become views of their own: statements are built from each other here, and the
    optimizer doesn't take nested shared subqueries (it fails on repeated definitions).
    """
    made = []

    def view(df: DataFrame) -> str:
        made.append(f"mergewell_view_{next(_VIEWS)}")
        df.createOrReplaceTempView(made[-1])
        return made[-1]

    try:
        for name, df in tables.items():
            if "{" + name + "}" in text:
                text = text.replace("{" + name + "}", view(df))
        text = text.strip()
        if text[:5].upper() == "WITH ":
            text = text[5:]
            while m := re.match(r"\s*(\w+)\s+AS\s*\(", text):
                end = _closing(text, m.end() - 1)
                body, rest = text[m.end() : end], text[end + 1 :].lstrip()
                own = view(spark.sql(body))
                # A reference without an alias keeps its name as one.
                aliased = r"(?=\s+(?!(?:WHERE|JOIN|LEFT|RIGHT|FULL|INNER|CROSS|SEMI|ANTI|ON|USING|GROUP|UNION|ORDER|HAVING|LATERAL|LIMIT|EXCEPT|INTERSECT)\b)\w)"
                text = re.sub(rf"\b(FROM|JOIN)(\s+){m[1]}\b{aliased}", rf"\1\2{own}", rest)
                text = re.sub(rf"\b(FROM|JOIN)(\s+){m[1]}\b", rf"\1\2{own} {m[1]}", text)
                if not text.startswith(","):
                    break
                text = text[1:]
        return spark.sql(text)
    finally:  # the plan is analysed by now and needs the names no more
        for name in made:
            spark.catalog.dropTempView(name)
