"""Selectors as data: rules that travel with a page instead of standing in the plan.

The selectors of a specification are taken apart into rules, one for every step of every chain. A rule has a key, the most telling of its
simple selectors, which an element must have among its own keys (tag, id, classes, attribute names) before the rest is looked at.
Pages bring the rules of their profile along, so the plan is the same for any number of profiles and
nothing of them passes through the driver. Rules are matched against the different start tags of a page, not against every token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmill.functions import html as H
from corpusmill.functions.regex import let
from corpusmill.operators.tokens import KEYS, class_list

# What a match is for; in a rule they are numbers.
TITLE, CONTENT, EXCLUDE = 0, 1, 2

_STEP = r"(?U)(?:\[[^\]]*\]|[^\s\[])+"
_SIMPLE = r"""(?U)[A-Za-z][\w-]*|\*|\.[\w-]+|#[\w-]+|\[\s*[\w-]+\s*(?:[~|^$*]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+))?\s*\]"""


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chains(selector: Column) -> Column:
    """Comma groups, each an array of steps from ancestor to element."""
    groups = F.split(F.coalesce(selector, F.lit("")), r",(?![^\[]*\])", -1)
    return F.filter(F.transform(groups, lambda g: _all(g, _STEP)), lambda steps: F.size(steps) > 0)


def selector_problem(selectors: Column) -> Column:
    """Why one of the selectors (``title, content, exclude``) cannot be used, or NULL."""
    texts = F.concat(F.array(selectors["title"], selectors["content"]), F.coalesce(selectors["exclude"], F.array().cast("array<string>")))
    steps = F.flatten(F.transform(texts, lambda t: F.flatten(chains(t))))
    odd = F.filter(steps, lambda s: F.array_join(_all(s, _SIMPLE), "") != s)
    return F.when(F.size(odd) > 0, F.concat(F.lit("unsupported selector: '"), F.get(odd, F.lit(0)), F.lit("'")))


def attribute_test(found: Column, sign: Column, value: Column) -> Column:
    """Whether an attribute's value meets ``[name=value]``, or what one of the signs ``~ | ^ $ *`` before the ``=`` asks for."""
    some = value != ""
    return (
        F.when(sign == "", found == value)
        .when(sign == "~", some & ~value.rlike(r"[\t\n\f\r ]") & F.array_contains(class_list(found), value))
        .when(sign == "|", (found == value) | F.startswith(found, F.concat(value, F.lit("-"))))
        .when(sign == "^", some & F.startswith(found, value)).when(sign == "$", some & F.endswith(found, value))
        .otherwise(some & F.contains(found, value))
    )


def _attribute(part: Column) -> Column:
    value = [F.regexp_extract(part, r"""(?s)=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))""", i) for i in (1, 2, 3)]
    return F.struct(
        F.lower(F.regexp_extract(part, r"(?U)\[\s*([\w-]+)", 1)).alias("name"), F.regexp_extract(part, r"(?U)\[\s*[\w-]+\s*([~|^$*]?)=", 1).alias("sign"),
        F.when(part.contains("="), F.concat(*value)).alias("value"))


def _compound(step: Column) -> Column:
    """What one step such as ``div.note[role='main']`` asks for."""

    def taken(parts: Column) -> Column:
        named = lambda mark: F.transform(F.filter(parts, lambda p: p.startswith(mark)), lambda p: F.substring(p, 2, 1 << 30))
        tags = F.transform(F.filter(parts, lambda p: p.rlike("^[A-Za-z]")), lambda p: F.lower(p))
        ids, classes = named("#"), named(".")
        attrs = F.transform(F.filter(parts, lambda p: p.startswith("[")), _attribute)
        first = lambda values, mark: F.concat(F.lit(mark), F.get(values, F.lit(0)))
        key = F.coalesce(first(ids, "#"), first(classes, "."), first(F.transform(attrs, lambda a: a["name"]), "["), F.get(tags, F.lit(0)), F.lit("*"))
        return F.struct(key.alias("key"), tags.alias("tags"), ids.alias("ids"), classes.alias("classes"), attrs.alias("attrs"))

    return let(_all(step, _SIMPLE), taken)


def rules(selectors: Column) -> Column:
    """All rules of one specification's selectors: what a step asks for, and its ``role, chain, step, last``."""
    exclude = F.array_join(F.coalesce(selectors["exclude"], F.array().cast("array<string>")), ", ")
    own = lambda text, role: F.transform(chains(text), lambda steps: F.struct(F.lit(role).alias("role"), steps.alias("steps")))
    every = F.concat(own(selectors["title"], TITLE), own(selectors["content"], CONTENT), own(exclude, EXCLUDE))
    return F.flatten(F.transform(every, lambda c, i: F.transform(c["steps"], lambda s, k: F.struct(
        _compound(s).alias("asks"), c["role"].alias("role"), i.alias("chain"), k.alias("step"), (k == F.size(c["steps"]) - 1).alias("last")))))


def longest_chain(selectors: Column) -> Column:
    """Most steps of any chain."""
    texts = F.concat(F.array(selectors["title"], selectors["content"]), F.coalesce(selectors["exclude"], F.array().cast("array<string>")))
    return F.array_max(F.transform(texts, lambda t: F.coalesce(F.array_max(F.transform(chains(t), lambda c: F.size(c))), F.lit(0))))


def _matches(rule: Column, element: Column) -> Column:
    asks = rule["asks"]
    attrs = element["attrs"]
    return (
        F.array_contains(element["keys"], asks["key"])
        & F.forall(asks["tags"], lambda t: t == element["tag"])
        & F.forall(asks["ids"], lambda i: F.coalesce(attrs["id"] == i, F.lit(False)))
        & F.forall(asks["classes"], lambda c: F.array_contains(element["classes"], c))
        & F.forall(asks["attrs"], lambda a: F.coalesce(attrs[a["name"]].isNotNull() & (a["value"].isNull() | attribute_test(attrs[a["name"]], a["sign"], a["value"])), F.lit(False)))
    )


HIT = "array<struct<role:int,chain:int,step:int,last:boolean>>"


def hits(start_tag: Column, all_rules: Column) -> Column:
    """``role, chain, step, last`` of the rules whose step a start tag matches."""
    attrs = F.coalesce(H.attributes(start_tag), F.create_map().cast("map<string,string>"))

    def element(a: Column) -> Column:
        tag = H.token_tag(start_tag)
        classes = F.coalesce(class_list(a["class"]), F.array().cast("array<string>"))
        keys = F.concat(
            F.array(F.lit("*"), tag, F.concat(F.lit("#"), a["id"])), F.transform(classes, lambda c: F.concat(F.lit("."), c)),
            F.transform(F.map_keys(a), lambda n: F.concat(F.lit("["), n)))
        return F.struct(tag.alias("tag"), a.alias("attrs"), classes.alias("classes"), F.array_compact(keys).alias("keys"))

    found = let(attrs, lambda a: let(element(a), lambda e: F.filter(all_rules, lambda r: _matches(r, e))))
    return F.transform(found, lambda r: F.struct(r["role"], r["chain"], r["step"], r["last"]))


def token_hits(tokens: Column, all_rules: Column) -> Column:
    """For every token of a page the hits of its start tag; NULL for other tokens and for tags without any.

    A page has far fewer different start tags than tokens, so these are matched, and tokens find theirs.
    """
    is_start = lambda t: t.rlike("^<[A-Za-z]")
    different = F.array_distinct(F.filter(tokens, is_start))
    matched = F.filter(
        F.transform(different, lambda t: F.struct(t.alias("text"), hits(t, all_rules).alias("hits"))), lambda m: F.size(m["hits"]) > 0)
    return let(F.struct(F.transform(matched, lambda m: m["text"]).alias("texts"), F.transform(matched, lambda m: m["hits"]).alias("hits")), lambda known: F.transform(
        tokens, lambda t: F.when(is_start(t), F.get(known["hits"], F.array_position(known["texts"], t).cast("int") - 1))))


def flag_by_hits(stream: DataFrame, names: dict[int, str], steps: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add one boolean column per role (``names``) to an event stream with ``hits``; both events of a matching element are flagged.

    ``steps`` is the length of the longest chain. A step of a chain holds where an element of the step before it is open. Chains of several
    steps are followed by rows of their own, one for every step that an element could be; all chains of all pages
    take each step together.
    """
    is_event = H.one_of("kind", ("open", "end", "void", "raw"))
    columns = list(stream.columns)
    alone = lambda role: is_event & F.coalesce(F.exists("hits", lambda h: (h["role"] == role) & h["last"] & (h["step"] == 0)), F.lit(False))
    if steps < 2:
        return stream.select(*columns, *[alone(role).alias(name) for role, name in names.items()]).drop("hits")
    rest = [c for c in columns if c != "hits"]
    flags = [alone(role).alias(name) for role, name in names.items()]
    linked = F.filter(F.col("hits"), lambda h: ~(h["last"] & (h["step"] == 0)))
    marks = F.concat(F.array(F.lit(None).cast(HIT[6:-1])), F.when(is_event, F.coalesce(linked, F.array().cast(HIT))).otherwise(F.array().cast(HIT)))
    marked = stream.select(*rest, *flags, F.explode(marks).alias("mark")).withColumn("_held", F.col("mark.step") == 0)
    # of one element the later steps come first, so that it is not taken for its own ancestor
    before = W.partitionBy(*keys, "mark.chain").orderBy("ord", F.desc("mark.step")).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*keys, "open_pos", "mark.chain", "mark.step")
    for step in range(1, steps):
        earlier = F.col("_held") & (F.col("mark.step") == step - 1)
        opened = F.sum(F.when(earlier & (F.col("kind") == "open"), 1).when(earlier & (F.col("kind") == "end"), -1)).over(before)
        now = F.when(F.col("mark.step") == step, F.coalesce(opened > 0, F.lit(False)) & (F.col("kind") != "end")).otherwise(F.col("_held"))
        # ends take the answer of their start, so that starts and ends always balance
        marked = marked.withColumn("_now", now).withColumn("_held", F.max("_now").over(own)).drop("_now")
    element = W.partitionBy(*keys, "open_pos")
    for role, name in names.items():
        reached = F.coalesce(F.max(F.col("_held") & F.col("mark.last") & (F.col("mark.role") == role)).over(element), F.lit(False))
        marked = marked.withColumn(name, F.col(name) | (is_event & reached))
    return marked.filter("mark IS NULL").select(*rest, *names.values())
