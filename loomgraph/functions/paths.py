"""Predicates on file paths as column expressions, one regular expression per rule and case.

The patterns are plain strings that Java's and RE2's engines read alike, so that SQL can use the same ones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# on the lower-cased path, and on the path as it is
TEST_LOWER = r"(^|/)test[_.][^/]*$|[._-](tests?|specs?)\.[a-z0-9]+$|/(tests?|__tests__|specs?|testlib|testing)/|^(tests?|specs?)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
TEST_CASED = r"(Tests?|TestCase|Tester|Specs?)\.[A-Za-z0-9]+$|(^|/)[A-Za-z0-9]*(Tests?|Spec)/"
GENERATED_RANK = r"(\.pb(\.gw)?|\.pulsar|\.generated|_gen|\.gen)\.go$|\.generated\.tsx?$|/(vendor|__generated__|generated)/"
GENERATED_SOURCE = (
    r"\.(pb|pulsar)\.go$|_mocks?\.go$|^mock_[^/]+\.go$|\.(generated|gen)\.[jt]sx?$|[._]pb\.[jt]s$|_grpc_pb\.[jt]s$|_pb2(_grpc)?\.py$|_pb2\.pyi$"
    r"|\.pb\.(cc|h|swift)$|\.g\.(cs|dart)$|(Grpc\.(cs|java)|OuterClass\.java)$|\.(freezed|pb|pbgrpc|chopper)\.dart$|\.generated\.rs$"
)
AFFECTED_TEST = r"\.(spec|test)\.|_test\.go|/(__tests__|tests|test|e2e|spec)/"
_LOW = r"_test\.(go|py|rb|dart)$|(^|/)test_[^/]+\.py$|_spec\.rb$|\.(test|spec)\.[jt]sx?$|(test|spec|tests)\.(java|kt|scala)$|(tests?|spec)\.cs$|tests?\.swift$"
LOW_VALUE_DOMINANT = r"(^|/)(tests?|__tests?__|spec)/|" + _LOW
LOW_VALUE_EXPLORE = r"/(tests?|__tests?__|spec)/|\bicons?\b|\bi18n\b|" + _LOW


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST_LOWER) | path.rlike(TEST_CASED)


def is_generated(path: Column) -> Column:
    """For ranking."""
    return F.lower(path).rlike(GENERATED_RANK)


def is_generated_source(path: Column) -> Column:
    """For extraction: by the name alone."""
    return path.rlike(GENERATED_SOURCE)


def is_affected_test(path: Column, glob: str | None = None) -> Column:
    return path.rlike(glob_pattern(glob) if glob else AFFECTED_TEST)


def is_low_value(path: Column, explore: bool = False) -> Column:
    return F.lower(path).rlike(LOW_VALUE_EXPLORE if explore else LOW_VALUE_DOMINANT)


def glob_pattern(glob: str, anchored: bool = True) -> str:
    """A regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out = re.sub(
        r"\*\*/|\*\*|\*|\?|[^*?]+",
        lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", m[0]),
        glob,
    )
    return f"^{out}$" if anchored else out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; a point where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def clean(path: Column) -> Column:
    """Without empty parts, points and what ``..`` takes back."""
    step = lambda a, p: F.when((p == "") | (p == "."), a).when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def in_folder(path: Column, folder: str = "", glob: str = "") -> Column:
    """Listing filter: under a folder, and matching a glob."""
    own = path.startswith(folder.strip("/") + "/") if folder.strip("/") else F.lit(True)
    return own & path.rlike(glob_pattern(glob)) if glob else own
