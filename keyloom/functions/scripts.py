"""Scripts and libraries of functions: SQL expressions that are registered by name, cached by digest, and called on columns.

A script is an expression over its arguments, so it runs in the same generated code as everything else, can be listed
and dumped as text, and needs no second language. ``register`` takes a vectorised Python function where an expression
can't say it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from keyloom.functions.ranges import matches

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def register(spark: SparkSession, name: str, script: Callable[..., pd.Series], returns: str) -> None:
    """Make ``script`` (columns in, a column out) callable as ``name`` in SQL and expressions; a second one replaces it."""

    def run(*columns: pd.Series) -> pd.Series:
        return script(*columns)

    one: Callable[[pd.Series], pd.Series] = lambda a: run(a)
    one.__annotations__ = {"a": pd.Series, "return": pd.Series}
    spark.udf.register(name, pandas_udf(one, returns))


def known(spark: SparkSession) -> list[str]:
    return [f.name for f in spark.catalog.listFunctions() if f.isTemporary]


@dataclass(frozen=True)
class Function:
    """A function of a library: arguments with types, the type of its result, its expression, and whether it only reads."""

    name: str
    arguments: str
    returns: str
    body: str
    reads_only: bool = False


class Libraries:
    """FUNCTION and FCALL: libraries of SQL functions in a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}  # type: SparkSession, dict[str, list[Function]]

    def load(self, library: str, functions: list[Function], replace: bool = False) -> str:
        """FUNCTION LOAD [REPLACE]: the library's name. A name that another library has is refused."""
        if library in self.held and not replace:
            raise ValueError(f"library {library} is there already")
        taken = {f.name for name, other in self.held.items() if name != library for f in other}
        for f in functions:
            if not _NAME.match(f.name) or f.name in taken:
                raise ValueError(f"function {f.name} is there already, or is no name")
        if library in self.held:
            self.delete(library)
        for f in functions:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.arguments}) RETURNS {f.returns} RETURN {f.body}")
        self.held[library] = list(functions)
        return library

    def delete(self, library: str) -> None:
        if library not in self.held:
            raise KeyError("library not found")
        for f in self.held.pop(library):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {f.name}")

    def flush(self) -> None:
        for library in list(self.held):
            self.delete(library)

    def list(self, pattern: str = "*") -> DataFrame:
        """FUNCTION LIST: library, name, reads_only, body of the libraries whose name matches a glob."""
        rows = [(library, f.name, f.reads_only, f.body) for library, fs in sorted(self.held.items()) for f in fs]
        every = self.spark.createDataFrame(rows, "library string, name string, reads_only boolean, body string")
        return every.filter(matches(F.col("library"), pattern))

    def dump(self) -> str:
        return json.dumps({library: [asdict(f) for f in fs] for library, fs in sorted(self.held.items())})

    def restore(self, dumped: str, policy: str = "append") -> None:
        """FUNCTION RESTORE: append refuses a library that is there, replace takes its place, flush first drops all."""
        loaded = {library: [Function(**f) for f in fs] for library, fs in json.loads(dumped).items()}
        if policy == "flush":
            self.flush()
        elif policy == "append" and self.held.keys() & loaded.keys():
            raise ValueError("a library is there already")
        for library, fs in loaded.items():
            self.load(library, fs, replace=True)

    def call(self, name: str, *arguments: str | Column, reads_only: bool = False) -> Column:
        """FCALL (FCALL_RO): the function over columns; FCALL_RO refuses one that may write."""
        found = next((f for fs in self.held.values() for f in fs if f.name == name), None)
        if found is None:
            raise KeyError("function not found")
        if reads_only and not found.reads_only:
            raise ValueError("can not call a function that may write")
        return F.call_function(name, *[F.col(a) if isinstance(a, str) else a for a in arguments])


class Scripts:
    """EVAL, EVALSHA and SCRIPT: expressions over the columns of a table, cached by the SHA-1 of their text."""

    def __init__(self) -> None:
        self.cache: dict[str, str] = {}

    def load(self, text: str) -> str:
        digest = hashlib.sha1(text.encode()).hexdigest()  # noqa: S324  the cache key is defined so
        self.cache[digest] = text
        return digest

    def exists(self, *digests: str) -> list[int]:
        return [int(d.lower() in self.cache) for d in digests]

    def flush(self) -> None:
        self.cache.clear()

    def eval(self, text: str) -> Column:
        """EVAL (EVAL_RO): the script is cached and run. An expression writes nothing, so both are one."""
        return F.expr(self.cache[self.load(text)])

    def evalsha(self, digest: str) -> Column:
        """EVALSHA (EVALSHA_RO)."""
        if digest.lower() not in self.cache:
            raise KeyError("NOSCRIPT no matching script")
        return F.expr(self.cache[digest.lower()])
