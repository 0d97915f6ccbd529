"""Text of diagnoses and trajectories: step blocks, condensation, identifier stripping, rendering."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import json_text as jt
from runlens.functions import scale
from runlens.functions import text as tx

c = F.col


# ------------------------------------------------------------------ step blocks


def step_blocks(
    entries: DataFrame, reasoning: int = 240, content: int = 300, arguments: int = 300, observation: int = 240
) -> DataFrame:
    """(rollout_id, step, text): one block per step, every field cut to its head.

    The lines collected for a block are those of one message and its tool results.
    """
    def line(cond: Column, text: Column) -> Column:
        return F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))

    says, thinks = F.coalesce(c("message.content"), F.lit("")), F.coalesce(c("message.reasoning_content"), F.lit(""))
    calls = F.transform(
        F.coalesce(c("message.tool_calls"), F.array()),
        lambda x: F.concat(
            F.lit("  call "), F.coalesce(x["name"], F.lit("?")), F.lit("("), tx.head(x["arguments"], arguments), F.lit(")")
        ),
    )
    out, err = F.coalesce(c("tool_output.stdout"), F.lit("")), F.coalesce(c("tool_output.stderr"), F.lit(""))
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("exit="), c("tool_output.exit_code").cast("string")),
        F.when(c("tool_output.timeout"), "TIMEOUT"),
        F.when(out != "", F.concat(F.lit("stdout: "), out)),
        F.when(err != "", F.concat(F.lit("stderr: "), err)),
    )
    has_streams = c("tool_output.stdout").isNotNull() | c("tool_output.stderr").isNotNull()
    observed = F.when(has_streams, parts).otherwise(F.coalesce(c("tool_output.content"), F.lit("")))
    spoken = F.concat(
        line(thinks != "", F.concat(F.lit("  reasoning: "), tx.head(thinks, reasoning))),
        line(says != "", F.concat(F.lit("  says: "), tx.head(says, content))),
        calls,
    )
    if "substituted" in entries.columns:
        spoken = F.concat(spoken, line(F.coalesce(c("substituted"), F.lit(False)), F.lit("  [substituted reference action]")))
    returned = F.array(
        F.concat(F.lit("  observation["), F.coalesce(c("tool_call.name"), F.lit("?")), F.lit("]: "), tx.head(observed, observation))
    )
    lines = F.when(c("role") == "assistant", spoken).when(c("role") == "tool", returned).otherwise(
        F.array().cast("array<string>"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "lines")))
    return (
        entries.select("rollout_id", "step", "ord", lines.alias("lines"))
        .groupBy("rollout_id", "step")
        .agg(F.flatten(ordered["lines"]).alias("lines"))
        .select(
            "rollout_id", "step",
            F.concat_ws("\n", F.concat(F.array(F.concat(F.lit("step "), c("step").cast("string"), F.lit(":"))), c("lines"))).alias("text"),
        )
    )


def condense_steps(blocks: DataFrame, budget: int = 20_000, keep: DataFrame | None = None) -> DataFrame:
    """(rollout_id, text): blocks joined by newlines within a character budget.

    Over budget, blocks are dropped from the middle outwards until the rest fits; the first two,
    the last two and the ``keep`` steps (rollout_id, step) with their neighbours always stay. A
    block goes exactly when the text without the blocks dropped before it is still too long, so
    the drops are a running sum over the drop order. Only kept blocks, which the budget bounds,
    are collected per rollout.
    """
    rows = blocks.withColumn("_len", F.length("text").cast("long"))
    ranked = scale.bucketed_rank(rows, ["rollout_id"], F.floor(c("step") / 256), [c("step")], "_pos")
    totals = rows.groupBy("rollout_id").agg(
        F.count(F.lit(1)).alias("_n"), (F.sum("_len") + F.count(F.lit(1)) - 1).alias("_total")
    )
    rows = ranked.join(totals, "rollout_id").withColumn("_pos", c("_pos") - 1)
    protected = (c("_pos") < 2) | (c("_pos") >= c("_n") - 2)
    if keep is not None:
        near = keep.select("rollout_id", F.explode(F.array(c("step") - 1, c("step"), c("step") + 1)).alias("step"))
        rows = rows.join(near.distinct().withColumn("_kept", F.lit(True)), ["rollout_id", "step"], "left")
        protected = protected | c("_kept").isNotNull()
    over = c("_total") > budget
    candidates = rows.where(over & ~protected).withColumn("_far", F.abs(2 * c("_pos") - c("_n")))
    candidates = candidates.withColumn("_cost", c("_len") + 1)
    dropped = (
        scale.bucketed_running_sum(
            candidates, ["rollout_id"], F.floor(c("_far") / 512), [c("_far"), c("_pos")], "_cost", "_gone"
        )
        .where(c("_total") - c("_gone") > budget)
        .select("rollout_id", "_pos")
    )
    kept = rows.join(dropped, ["rollout_id", "_pos"], "left_anti")
    w = Window.partitionBy("rollout_id").orderBy("_pos")
    gap = c("_pos") - F.coalesce(F.lag("_pos").over(w), F.lit(-1)) - 1
    marked = kept.withColumn("_gap", gap).withColumn(
        "_line",
        F.when(c("_gap") > 0, F.concat(F.lit("  … "), c("_gap").cast("string"), F.lit(" step(s) omitted …\n"), c("text")))
        .otherwise(c("text")),
    )
    return (
        marked.groupBy("rollout_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_line"))).alias("_l"))
        .select("rollout_id", F.concat_ws("\n", c("_l._line")).alias("text"))
    )


# ------------------------------------------------------------------ identifiers


def identifier_tokens(
    files: Iterable[str] = (),
    symbols: Iterable[str] = (),
    tools: Iterable[str] = (),
    layers: Iterable[str] = (),
    components: Iterable[str] = (),
    extra: Iterable[str] = fixed.EXTRA_IDENTIFIERS,
) -> dict[str, str]:
    """Token -> placeholder class for a manifest; component ids win over same-named tokens.

    ``extra`` are names outside the manifest: a routine with a capital first letter, else a path,
    where the manifest does not say otherwise.
    """
    tokens = {f: "path" for f in files}
    for symbol in symbols:
        path, _, rest = symbol.partition(":")
        tokens[path] = "path"
        name = rest.partition("@")[0]
        if path.endswith(".json"):
            tokens.update({name: "setting"} if name else {})
        else:
            tokens.update({p: "routine" for p in name.split(".") if p not in ("", "__init__")})
    tokens.update({t: "tool" for t in [*tools, fixed.SHELL_TOOL, fixed.FINISH_TOOL]})
    for name in extra:
        tokens.setdefault(name, "routine" if name[0].isupper() else "path")
    tokens.update({x: "layer" for x in layers})
    tokens.update({x: "component" for x in components})
    return tokens


def any_of(words: Iterable[str]) -> str:
    """A pattern for the longest of the words at a place: their trie, so that shared beginnings are read once."""
    trie: dict = {}
    for word in words:
        node = trie
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [_literal(char) + pattern(below) for char, below in sorted(node.items()) if char]
        if not parts:
            return ""
        together = f"(?:{'|'.join(parts)})" if len(parts) > 1 or "" in node else parts[0]
        return together + "?" if "" in node else together

    return pattern(trie)


def _literal(text: str) -> str:
    return "".join(x if x.isalnum() or x == "_" else "\\" + x if x.isascii() and not x.isspace() else f"\\x{{{ord(x):x}}}" for x in text)


def _vocabulary(tokens: dict[str, str]) -> tuple[list[dict], dict[str, list[int]]]:
    """Tokens in the order of replacement, and for each which places in it an occurrence may need.

    Those are the tokens inside it (it may itself be held back by its neighbours) and, as one
    replaced text may hold another token, the tokens inside their placeholders, and so on.
    """
    order = sorted((t for t in tokens if t), key=lambda t: -len(t))
    rows = []
    for token in order:
        edge = r"[\w/]" if "/" in token or "." in token else r"\w"
        # the name comes first: its letters are searched for, its neighbours looked at where they are found
        name = _literal(token)
        rows.append({"pattern": rf"(?U){name}(?<!{edge}{name})(?!{edge})", "mark": f"[{tokens[token]}]", "class": tokens[token]})
    inside = {token: {k for k, t in enumerate(order) if t in token} for token in order}
    by_mark = {row["mark"]: {k for k, t in enumerate(order) if t in row["mark"]} for row in rows}
    bracketed = {k for k, t in enumerate(order) if "[" in t or "]" in t}
    places = {}
    for token in order:
        found, new = set(), inside[token] | bracketed
        while new - found:
            found |= new
            new = set().union(*(by_mark[rows[k]["mark"]] for k in new))
        places[token] = sorted(found)
    return rows, places


def _searches(tokens: Iterable[str]) -> list[str]:
    """Patterns that find the longest token at every place.

    One that begins like a word can only begin where no word goes on: a replaced neighbour ends
    where its own word ends. One that begins with a mark may follow upon a replaced neighbour.
    """
    words = {t for t in tokens if t[0] == "_" or (t[0].isascii() and t[0].isalnum())}
    out = []
    for group, before in ((words, r"(?<!\w)"), (set(tokens) - words, "")):
        if group:
            first = "".join(sorted(_literal(t[0]) for t in group))
            out.append(f"(?U)(?=[{first}]){before}(?=({any_of(group)}))")
    return out


def stripped(text: Column, tokens: dict[str, str]) -> Column:
    """struct<text, counts>: the text with tokens replaced by class placeholders, longest first;
    ``counts`` is a struct of the replacements per class.

    One pass over the text finds which tokens occur at all; a fold over those, in order of length,
    cuts the running text at each one and joins the parts with its placeholder.
    """
    classes = sorted(set(tokens.values()))
    rows, places = _vocabulary(tokens)
    if not rows:
        counts = F.struct(*[F.lit(0).alias(k) for k in classes or ["none"]])
        return F.struct(text.alias("text"), counts.alias("counts"))
    vocabulary = F.from_json(F.lit(json.dumps(rows)), "array<struct<pattern:string,mark:string,class:string>>")
    where = F.from_json(F.lit(json.dumps(places)), "map<string,array<int>>")
    hits = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _searches(places)]))
    needed = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.try_element_at(where, x)))))
    zero = F.struct(text.alias("text"), F.struct(*[F.lit(0).alias(k) for k in classes]).alias("counts"))

    def replaced(acc: Column, place: Column) -> Column:
        def joined(row: Column) -> Column:
            return jt.let(F.split(acc["text"], row["pattern"], -1), lambda parts: F.struct(
                F.call_function("array_join", parts, row["mark"]).alias("text"),
                F.struct(*[(acc["counts"][k] + F.when(row["class"] == k, F.size(parts) - 1).otherwise(0)).alias(k) for k in classes]).alias("counts")))

        return jt.let(F.get(vocabulary, place), joined)

    def unquoted(acc: Column) -> Column:
        return F.struct(F.regexp_replace(acc["text"], r"(?U)`\[(\w+)\]`", "[$1]").alias("text"), acc["counts"].alias("counts"))

    return F.aggregate(needed, zero, replaced, unquoted)


def strip_identifiers(df: DataFrame, column: str, tokens: dict[str, str], counts: bool = True) -> DataFrame:
    """Replaces tokens, longest first, by class placeholders; adds ``<column>_<class>`` counts.

    Null texts stay null, with counts of zero. The tokens are a manifest's vocabulary, a few
    hundred names or more: a text is searched for all of them at once.
    """
    out = df.withColumn("_stripped", stripped(c(column), tokens))
    made = {column: c("_stripped.text")}
    if counts:
        for k in sorted(set(tokens.values())):
            made[f"{column}_{k}"] = F.coalesce(c(f"_stripped.counts.{k}"), F.lit(0))
    return out.withColumns(made).drop("_stripped")


# ------------------------------------------------------------------ caps and templates


def field_caps(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key: the longest collapsed text of each field, at least 20 characters."""
    longest = [
        F.greatest(F.lit(fixed.MIN_FIELD_CAP), F.max(F.length(tx.collapse(c(f))))).alias(f"{f}_cap") for f in fields
    ]
    return df.groupBy(*keys).agg(*longest)


def fit_text(text: Column, cap: Column) -> Column:
    """Collapsed text, trimmed at a word boundary to the cap and closed with a full stop."""
    flat = tx.collapse(text)
    cut = F.substr(flat, F.lit(1), cap)
    at_word = F.when(cut.contains(" "), F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut)
    return F.when(F.length(flat) <= cap, flat).otherwise(F.concat(F.regexp_replace(at_word, r"[ ,;:]+$", ""), F.lit(".")))


#: The free texts of a diagnosis.
TEXT_FIELDS = ["mechanism", "fix_hint"]


def render_diagnosis(template: str = fixed.DIAGNOSIS_TEMPLATE, texts: dict[str, Column] | None = None) -> Column:
    """The template filled from component, step, severity, cause_label, mechanism and fix_hint;
    ``texts`` are used in place of the columns of their names."""
    out = F.lit(template)
    for name in ("component", "step", "severity", "cause_label", "mechanism", "fix_hint"):
        value = (texts or {}).get(name, c(name))
        value = F.coalesce(value.cast("string"), F.lit("unknown")) if name == "step" else value
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def caps_of(diagnoses: DataFrame, tokens: dict[str, str], key: str = "cluster_id") -> DataFrame:
    """(key, mechanism_cap, fix_hint_cap): per cluster the longest stripped text of each field, at least 20 characters."""
    texts = diagnoses.select(key, *[stripped(c(f), tokens)["text"].alias(f) for f in TEXT_FIELDS])
    return field_caps(texts, [key], TEXT_FIELDS)


def render_diagnoses(
    diagnoses: DataFrame, tokens: dict[str, str], caps: DataFrame | None = None, key: str = "cluster_id",
    template: str = fixed.DIAGNOSIS_TEMPLATE,
) -> DataFrame:
    """Diagnoses with their rendered ``text`` and what rendering did to them.

    Adds text, mechanism_length, fix_hint_length, mechanism_cut, fix_hint_cut and
    placeholder_<class>, the replacements in both fields. ``caps`` (key, mechanism_cap,
    fix_hint_cap) default to the longest texts of the cluster among these rows; a cluster without
    caps is not cut. Where the component is named stays as it is, identifiers in the two texts are
    replaced, then the texts are cut to their caps.
    """
    limits = caps_of(diagnoses, tokens, key) if caps is None else caps
    rows = diagnoses.withColumns({f"_{f}": stripped(F.coalesce(c(f), F.lit("")), tokens) for f in TEXT_FIELDS})
    rows = rows.join(limits.select(c(key), *[c(f"{f}_cap").alias(f"_{f}_cap") for f in TEXT_FIELDS]), key, "left")
    flat = {f: tx.collapse(c(f"_{f}.text")) for f in TEXT_FIELDS}
    cap = {f: F.coalesce(c(f"_{f}_cap"), F.length(flat[f])) for f in TEXT_FIELDS}
    fitted = rows.withColumns({f"_{f}_fit": fit_text(c(f"_{f}.text"), cap[f]) for f in TEXT_FIELDS})
    made = {"text": render_diagnosis(template, {f: c(f"_{f}_fit") for f in TEXT_FIELDS})}
    made |= {f"{f}_length": F.length(f"_{f}_fit") for f in TEXT_FIELDS}
    made |= {f"{f}_cut": F.length(flat[f]) > cap[f] for f in TEXT_FIELDS}
    for k in sorted(set(tokens.values())):
        made[f"placeholder_{k}"] = sum((F.coalesce(c(f"_{f}.counts.{k}"), F.lit(0)) for f in TEXT_FIELDS), F.lit(0))
    return fitted.withColumns(made).drop(*[f"_{f}{end}" for f in TEXT_FIELDS for end in ("", "_cap", "_fit")])


def rendered_lengths(arms: DataFrame, tokens: dict[str, str], caps: DataFrame | None = None) -> DataFrame:
    """(cluster_id, arm, mechanism_length, fix_hint_length, mechanism_cut, fix_hint_cut).

    ``arms``: cluster_id, arm, mechanism, fix_hint. Texts are stripped, then capped by ``caps``, or
    by the longest stripped text among the arms of their cluster.
    """
    filled = arms.select("cluster_id", "arm", *TEXT_FIELDS)
    limits = caps_of(filled, tokens) if caps is None else caps
    texts = filled.select("cluster_id", "arm", *[stripped(c(f), tokens)["text"].alias(f) for f in TEXT_FIELDS])
    rows = texts.join(limits, "cluster_id")
    return rows.select(
        "cluster_id", "arm",
        *[F.length(fit_text(c(f), c(f"{f}_cap"))).alias(f"{f}_length") for f in TEXT_FIELDS],
        *[(F.length(tx.collapse(c(f))) > c(f"{f}_cap")).alias(f"{f}_cut") for f in TEXT_FIELDS],
    )


def normalise_cause(df: DataFrame, column: str = "cause_label", vocabulary: Sequence[str] = tuple(fixed.CAUSES)) -> DataFrame:
    """Vocabulary id, lower-cased id, or ``other:<text>``; anything else is an error."""
    text = tx.strip(F.coalesce(c(column), F.lit("")))
    ids = list(vocabulary)
    other = F.concat(F.lit("other:"), F.lower(tx.strip(F.regexp_extract(text, r"(?s)^other:(.*)$", 1))))
    return df.withColumn(
        column,
        F.when(text.isin(ids), text)
        .when(F.lower(text).isin(ids), F.lower(text))
        .when(text.rlike("(?U)" + fixed.OTHER_CAUSE), other)
        .otherwise(F.raise_error(F.concat(F.lit("cause label not in the vocabulary: "), text))),
    )
