"""Masked results as DataFrames whose actions never quote values.

An error that Spark raises while a masked result runs may name a value that the policy
masks.  Every public method of a :class:`MaskedFrame` raises a refusal without the text in
its place, and so does all that is made from it: frames, groupings, writers, running
streams.  Its plans hold key material, so ``explain`` is refused; so are ways out to where
errors cannot be kept quiet (RDDs, local checkpoints, the pandas API, plots).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from threading import Lock

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame
from pyspark.sql.classic.dataframe import DataFrameNaFunctions, DataFrameStatFunctions
from pyspark.sql.group import GroupedData
from pyspark.sql.merge import MergeIntoWriter
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.readwriter import DataFrameWriter, DataFrameWriterV2
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..errors import Cause, PolicyRejection, withheld

#: What tells of the frame and never runs it.
_TELLING = frozenset("columns dtypes schema isStreaming isLocal storageLevel sparkSession sql_ctx printSchema colRegex sameSemantics semanticHash inputFiles __getitem__ __getattr__".split())
#: Ways to where errors are not this module's.
REFUSED = frozenset("explain rdd toJSON localCheckpoint pandas_api plot executionInfo".split())
#: What makes something that fails by itself later on.
_MADE = (GroupedData, PandasCogroupedOps, DataFrameNaFunctions, DataFrameStatFunctions, DataFrameWriter, DataFrameWriterV2, MergeIntoWriter, DataStreamWriter, StreamingQuery)


#: How many actions run under each tag just now.
RUNNING: Counter[str] = Counter()
_COUNTING = Lock()


@contextmanager
def tagged(context: SparkContext, tags: tuple[str, ...]) -> Iterator[None]:
    """Jobs of this thread carry ``tags``, by which they can be cancelled."""
    new = [t for t in tags if t not in context.getJobTags()]
    for t in new:
        context.addJobTag(t)
    with _COUNTING:
        RUNNING.update(new)
    try:
        yield
    finally:
        with _COUNTING:
            RUNNING.subtract(new)
            for t in new:
                if RUNNING[t] <= 0:
                    del RUNNING[t]
        for t in new:
            context.removeJobTag(t)


def quietly(act: Callable, tags: tuple[str, ...] = ()) -> Callable:
    """``act`` with Spark's errors replaced by a refusal, and its results kept quiet too."""

    @wraps(act)
    def run(*args, **named):
        try:
            return kept(act(*args, **named), tags)
        except (PySparkException, Py4JError, pa.ArrowException) as e:
            raise withheld(e, "the statement failed while it ran") from None

    return run


def kept(made, tags: tuple[str, ...] = ()):
    """What a quiet method gives, kept quiet."""
    if isinstance(made, ClassicFrame):
        return MaskedFrame.over(made, tags)
    if isinstance(made, list) and made and all(isinstance(m, ClassicFrame) for m in made):
        return [MaskedFrame.over(m, tags) for m in made]
    return Quiet(made, tags) if isinstance(made, _MADE) else made


class Quiet:
    """A grouping, writer or running stream whose methods raise no values."""

    def __init__(self, inner, tags: tuple[str, ...] = ()) -> None:
        self._inner, self._tags = inner, tags

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            found = getattr(self._inner, name)
        except (PySparkException, Py4JError) as e:
            raise withheld(e, "the statement failed while it ran") from None
        if not callable(found):
            return kept(found, self._tags)
        if name == "exception":
            return lambda: None if found() is None else withheld(found(), "the stream failed while it ran")

        def run(*args, **named):
            if name == "foreachBatch":  # what the sink gets is kept quiet as well
                sink = args[0] if args else named["func"]
                args, named = (lambda batch, number: sink(MaskedFrame.over(batch, self._tags), number),), {}
            with tagged(SparkContext.getOrCreate(), self._tags):
                out = quietly(found, self._tags)(*[a._inner if isinstance(a, Quiet) else a for a in args], **named)
            return self if isinstance(out, Quiet) and out._inner is self._inner else out

        return run


class MaskedFrame(ClassicFrame):
    """A classic DataFrame with quiet methods, whose jobs carry its statement's tags."""

    def __new__(cls, jdf, session, tags: tuple[str, ...] = ()):
        return super().__new__(cls, jdf, session)

    def __init__(self, jdf, session, tags: tuple[str, ...] = ()) -> None:
        super().__init__(jdf, session)
        self._tags = tags

    @staticmethod
    def over(frame: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
        if isinstance(frame, MaskedFrame):
            return frame
        if not isinstance(frame, ClassicFrame):
            raise PolicyRejection(Cause.NO_ACTIVE_PLAN, "results are served to classic sessions only")
        return MaskedFrame(frame._jdf, frame._session, tags)

    def transform(self, func: Callable[..., DataFrame], *args, **named) -> DataFrame:
        return quietly(func, self._tags)(self, *args, **named)

    def toLocalIterator(self, prefetchPartitions: bool = False):
        with tagged(self._session.sparkContext, self._tags):
            rows = quietly(_plain_of(self).toLocalIterator)(prefetchPartitions)
        step = quietly(lambda: next(rows, None))
        while (row := step()) is not None:
            yield row


def _plain_of(frame: MaskedFrame) -> ClassicFrame:
    return ClassicFrame(frame._jdf, frame._session)


def _quiet(name: str, is_property: bool):
    """The method over a plain frame, whose own steps need no quieting; its results are kept quiet."""
    if is_property:
        return property(lambda self: quietly(getattr, self._tags)(_plain_of(self), name))

    @wraps(getattr(ClassicFrame, name))
    def run(self, *args, **named):
        with tagged(self._session.sparkContext, self._tags):
            return quietly(getattr(_plain_of(self), name), self._tags)(*args, **named)

    return run


def public_names() -> list[str]:
    """All public methods and properties of a classic DataFrame that this module must deal with."""
    return sorted(n for n in dir(ClassicFrame) if not n.startswith("_") and n not in _TELLING)


def _refuse(name: str) -> Callable:
    def run(self, *args, **named):
        raise PolicyRejection(Cause.LEAKY_CATALOG, "plans of masked results hold key material and are not shown" if name == "explain" else f"{name} of a masked result is not served")

    return run


for _name in public_names():
    if _name in REFUSED:
        setattr(MaskedFrame, _name, _refuse(_name) if callable(getattr(ClassicFrame, _name)) else property(_refuse(_name)))
    elif _name not in MaskedFrame.__dict__:
        setattr(MaskedFrame, _name, _quiet(_name, not callable(getattr(ClassicFrame, _name))))
