"""Scalar rules over symbols as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ranks' multipliers by symbol kind.
KIND_BOOST = {"class": 1.5, "interface": 1.5, "enum": 1.4, "object": 1.3, "type": 1.3, "method": 1.2, "function": 1.2, "constructor": 1.1, "property": 0.7, "field": 0.7}
#: Confidence by depth, what inheritance edges add, and the buckets' bounds.
DEPTH_CONFIDENCE = [1.0, 0.7, 0.4, 0.2]
BEYOND_CONFIDENCE, INHERITANCE_BONUS = 0.1, 0.2

#: Archetypes by the name's ending, and by folder, in the order in which they are tried.
TEST_PATHS = "/(test|tests|testFixtures|__tests__)/"
SUFFIXES = [
    ("test", "(Test|IT|Spec|TestBuilder|TestFixture|TestData)$"), ("builder", "Builder$"), ("controller", "(Controller|Resource|Endpoint|RestController)$"),
    ("repository", "(Repository|Repo|Dao)$"), ("service", "(Service|ServiceImpl|UseCase|Handler)$"), ("mapper", "(Mapper|Converter|Translator|Marshaller|Unmarshaller)$"),
    ("dto", "(Dto|DTO|Request|Response|Payload|Command|Query|Event|Message)$"), ("config", "(Config|Configuration|Properties|Settings)$"), ("util", "(Util|Utils|Helper|Helpers)$"), ("exception", "(Exception|Error)$"),
]
FOLDERS = [
    ("dto", "/(dto|payload)/"), ("entity", "/(entity|entities|domain)/"), ("repository", "/(repository|repositories|dao)/"), ("controller", "/(controller|controllers|rest)/"),
    ("service", "/(service|services)/"), ("mapper", "/(mapper|mappers)/"), ("config", "/(config|configuration)/"), ("util", "/(util|utils|helpers)/"), ("exception", "/(exception|exceptions|errors)/"),
]


def kind_boost(kind: Column) -> Column:
    out = F.when(kind == "class", KIND_BOOST["class"])
    for k, v in list(KIND_BOOST.items())[1:]:
        out = out.when(kind == k, v)
    return out.otherwise(1.0)


def confidence(depth: Column, edge_kind: Column) -> Column:
    out = F.when(depth == 1, DEPTH_CONFIDENCE[0])
    for k, v in enumerate(DEPTH_CONFIDENCE[1:], 2):
        out = out.when(depth == k, v)
    bonus = F.when(edge_kind.isin("extends", "implements", "overrides"), INHERITANCE_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(out.otherwise(BEYOND_CONFIDENCE) + bonus, 6))


def confidence_bucket(value: Column) -> Column:
    """Five buckets of 0.2; the highest also holds 1."""
    return F.when(value >= 0.8, "0.8-1.0").when(value >= 0.6, "0.6-0.8").when(value >= 0.4, "0.4-0.6").when(value >= 0.2, "0.2-0.4").otherwise("0.0-0.2")


BUCKETS = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]


def _suffix(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), k) for k, p in SUFFIXES])


def archetype(name: Column, qualified_name: Column, path: Column, kind: Column) -> Column:
    """A test folder wins; then each candidate name against all endings; then the folders."""
    parts = F.split(qualified_name, r"\.")
    last, parent = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    base = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    outer = kind.isin("class", "interface", "enum", "object")
    candidates = [F.when(outer, name).otherwise(parent), F.when(outer, last).otherwise(base), F.when(outer, base).otherwise(last)]
    low = F.lower(path)
    return F.coalesce(F.when(low.rlike(TEST_PATHS.lower()), "test"), *[_suffix(c) for c in candidates], *[F.when(low.rlike(p), k) for k, p in FOLDERS], F.lit("other"))


def terms(*cols: Column) -> Column:
    """Lower-case terms of letters and digits, without stemming or stop words; null columns are skipped."""
    text = F.lower(F.concat_ws(" ", *cols))
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def escaped(text: Column) -> Column:
    """text as a LIKE pattern that matches itself alone."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def name_score(name: Column, qualified_name: Column, query: Column) -> Column:
    """Exact 1.0, but for case 0.9, beginning 0.7, inside the qualified name 0.5, else null."""
    low, q = F.lower(name), F.lower(query)
    return F.when(name == query, 1.0).when(low == q, 0.9).when(F.startswith(low, q), 0.7).when(F.contains(F.lower(qualified_name), q), 0.5)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def arity_fits(n: Column, least: Column, most: Column) -> Column:
    """A spread call or unknown parameters fit anything; no upper bound means a vararg."""
    return n.isNull() | least.isNull() | (n >= least) & (most.isNull() | (n <= most))


def same_signature(a: Column, b: Column, bounds_a: tuple[Column, Column], bounds_b: tuple[Column, Column]) -> Column:
    """Equal parameter types where both are fully known, else equal bounds."""
    known = lambda x: x.isNotNull() & ~F.exists(x, lambda v: v.isNull())
    return F.when(F.coalesce(known(a) & known(b), F.lit(False)), a == b).otherwise(bounds_a[0].eqNullSafe(bounds_b[0]) & bounds_a[1].eqNullSafe(bounds_b[1]))


def embedding_text(qualified_name: Column, signature: Column, doc: Column) -> Column:
    return F.concat_ws(" ", qualified_name, signature, doc)
