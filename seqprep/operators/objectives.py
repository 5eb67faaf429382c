"""Training and validation examples of the path-finding objectives.

Every builder is a projection: the line is split and encoded once, then array expressions
put the sequence together. Nothing is shuffled, and the same functions work on a stream.

Where an objective needs a longer target than the row has, the row keeps its plain form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from seqprep.functions.basics import computed_once, ints, let, masked, ones, repeat
from seqprep.functions.draws import Draws
from seqprep.functions.tokens import Vocab, encode, node_set, split_prompt_target
from seqprep.options import OBJECTIVES_V0, OBJECTIVES_V1, PrepOptions

# ---- fixed values -------------------------------------------------------------------------
ERROR_PERCENT = 40  # share of target positions altered for error detection, validation
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Row:
    """Column handles of one encoded line."""

    prompt: Column
    target: Column
    wrong: Column | None
    draws: Draws
    vocab: Vocab
    opts: PrepOptions

    def sym(self, symbol: str) -> Column:
        return F.lit(self.vocab.id_of(symbol)).cast("int")

    def one(self, symbol: str) -> Column:
        return ints(self.vocab.id_of(symbol))

    def nodes(self) -> Column:
        return node_set(self.prompt, self.vocab.nodes)

    def head(self) -> Column:
        """The prompt without its closing separator."""
        return F.slice(self.prompt, F.lit(1), F.size(self.prompt) - 1)

    def hit(self, probability: float) -> Column:
        return self.draws.uniform("gate") < F.lit(float(probability))


def parts(prompt: Column, given: Column, labels: Column) -> Column:
    """What a builder returns: unlabelled ids, then the ids put in and the labels for them.

    It is one struct column, so that everything a row draws is evaluated once.
    """
    return F.struct(prompt.alias("prompt"), given.alias("given"), labels.alias("labels"))


def plain(prompt: Column, target: Column) -> Column:
    return parts(prompt, target, target)


def _teacherforcing(row: Row) -> Column:
    return plain(row.prompt, row.target)


def _teacherless(row: Row) -> Column:
    blanks = F.transform(row.target, lambda t, i: F.when(i == 0, t).otherwise(row.sym("$")))
    return parts(row.prompt, blanks, row.target)


def replace_inner(target: Column, draws: Draws, nodes: Column) -> Column:
    """Every position but the first and the last takes a random node."""

    def noisy(n: Column) -> Column:
        return F.transform(
            target,
            lambda t, i: F.when(
                (i >= 1) & (i <= F.size(target) - 2),
                F.coalesce(draws.pick(n, "node", i), t),
            ).otherwise(t),
        )

    return let(nodes, noisy)


def _noisyguide(row: Row) -> Column:
    noisy = replace_inner(row.target, row.draws, row.nodes())
    given = F.when(row.hit(row.opts.noisy_target), noisy).otherwise(row.target)
    return parts(row.prompt, given, row.target)


def _noisytarget(row: Row) -> Column:
    size = F.size(row.target)
    at = F.lit(1) + row.draws.below(size - 3, "pos")
    state = F.struct(at.alias("at"), row.draws.pick(row.nodes(), "node").alias("node"))

    def noisy(d: Column) -> Column:
        return F.transform(
            row.target,
            lambda t, i: F.when(i == d["at"], F.coalesce(d["node"], t)).otherwise(t),
        )

    altered = (size >= 4) & row.hit(row.opts.noisy_target)
    target = F.when(altered, let(state, noisy)).otherwise(row.target)
    return let(target, lambda t: plain(row.prompt, t))


def _next_to_last(row: Row) -> Column:
    """Short task: only the next-to-last node, asked for by ``&``."""
    node = F.coalesce(
        F.try_element_at(row.target, F.lit(-2)), F.try_element_at(row.target, F.lit(-1))
    )
    short = plain(F.concat(row.head(), row.one("&")), F.array(node))
    return F.when(F.size(row.target) == 0, _teacherforcing(row)).otherwise(short)


def _mixtask_v1(row: Row) -> Column:
    full = row.draws.uniform("gate") > F.lit(float(row.opts.mixtask_ratio))
    return F.when(full, _teacherforcing(row)).otherwise(_next_to_last(row))


def _mixtask_v1_validation(row: Row) -> Column:
    short = row.hit(row.opts.mixtask_ratio)
    return F.when(short, _next_to_last(row)).otherwise(_teacherforcing(row))


def _mixtask_v0(row: Row) -> Column:
    """Short task: one node from the middle, its place told by a run of ``$``."""
    at = F.lit(2) + row.draws.below(F.size(row.target) - 3, "pos")

    def short(a: Column) -> Column:
        return plain(
            F.concat(row.head(), row.one("="), repeat(row.vocab.id_of("$"), a)),
            F.array(F.element_at(row.target, a + 1)),
        )

    full = (F.size(row.target) < 4) | row.hit(row.opts.mixtask_ratio)
    return F.when(full, _teacherforcing(row)).otherwise(let(at, short))


def _fit_prefix(row: Row) -> Column:
    sequence = F.concat(row.prompt, row.target)
    return let(sequence, lambda s: parts(F.slice(s, 1, 0), s, s))


def _improving(row: Row, keep_all: bool) -> Column:
    """Some positions are noisy in the prompt; the labels correct them and skip the others."""
    draws, dollar, dot = row.draws, row.sym("$"), row.sym(".")
    count = draws.below(F.size(row.target) + 1, "count")
    chosen = F.slice(draws.shuffled(row.target, "shuffle"), F.lit(1), count)
    state = F.struct(
        chosen.alias("at"), F.concat(row.nodes(), row.one("$")).alias("nodes")
    )

    def pair(s: Column) -> Column:
        noisy = F.transform(
            row.target,
            lambda t, i: F.when(
                F.array_contains(s["at"], i), draws.pick(s["nodes"], "node", i)
            ).otherwise(t),
        )
        kept = lambda t, i: (
            t if keep_all else F.when(draws.uniform("keep", i) < 0.5, t).otherwise(dollar)
        )
        better = F.transform(
            row.target,
            lambda t, i: F.when(F.array_contains(s["at"], i), kept(t, i)).otherwise(dot),
        )
        return F.struct(noisy.alias("noisy"), better.alias("better"))

    return let(
        let(state, pair),
        lambda m: plain(F.concat(row.prompt, m["noisy"], row.one(">")), m["better"]),
    )


def _marked(row: Row, noisy_and_marks: Column) -> Column:
    """Prompt with the noisy path; labels repeat it with a mark per node, then the right path."""

    def body(m: Column) -> Column:
        told = F.flatten(F.zip_with(m["noisy"], m["marks"], lambda a, b: F.array(a, b)))
        labels = F.concat(told, row.one(">"), row.target)
        return let(labels, lambda x: plain(F.concat(row.prompt, m["noisy"], row.one(">")), x))

    return let(noisy_and_marks, body)


def _error_detection(row: Row) -> Column:
    """Some nodes after the first come from the wrong path."""
    draws, plus, minus = row.draws, row.sym("+"), row.sym("-")
    size = F.size(row.target)
    count = F.when(size >= 2, draws.below(size - 1, "count")).otherwise(F.lit(0))
    places = F.filter(draws.shuffled(row.target, "shuffle"), lambda i: i >= 1)
    state = F.struct(
        F.slice(places, F.lit(1), count).alias("at"),
        F.coalesce(F.try_element_at(row.wrong, F.lit(1)), F.slice(row.target, 1, 0)).alias("w"),
    )

    def pair(s: Column) -> Column:
        hit = lambda i: F.array_contains(s["at"], i) & (i < F.size(s["w"]))
        noisy = F.transform(
            row.target, lambda t, i: F.when(hit(i), F.element_at(s["w"], i + 1)).otherwise(t)
        )
        marks = F.transform(row.target, lambda _, i: F.when(hit(i), minus).otherwise(plus))
        return F.struct(noisy.alias("noisy"), marks.alias("marks"))

    return _marked(row, let(state, pair))


def _error_count(target: Column) -> Column:
    return F.floor(F.size(target) * ERROR_PERCENT / 100).cast("int")


def _error_detection_validation(row: Row) -> Column:
    """A fixed share of the nodes is replaced by another node of the prompt."""
    draws, plus, minus = row.draws, row.sym("+"), row.sym("-")
    state = F.struct(
        F.slice(
            draws.shuffled(row.target, "shuffle"), F.lit(1), _error_count(row.target)
        ).alias("at"),
        row.nodes().alias("nodes"),
    )

    def pair(s: Column) -> Column:
        other = lambda t, i: let(
            F.filter(s["nodes"], lambda n: n != t), lambda o: draws.pick(o, "node", i)
        )
        noisy = F.transform(
            row.target,
            lambda t, i: F.when(F.array_contains(s["at"], i), other(t, i)).otherwise(t),
        )
        marks = F.transform(
            row.target,
            lambda _, i: F.when(F.array_contains(s["at"], i), minus).otherwise(plus),
        )
        return F.struct(noisy.alias("noisy"), marks.alias("marks"))

    return _marked(row, let(state, pair))


def _error_detection_possible(row: Row) -> Column:
    """At least one place to alter, and another node for every place."""
    enough = let(
        row.nodes(),
        lambda n: (F.size(n) > 1)
        | ((F.size(n) == 1) & ~F.exists(row.target, lambda t: F.array_contains(n, t))),
    )
    return (_error_count(row.target) > 0) & enough


def _step_eval(row: Row) -> Column:
    """Some wrong paths, each ended by ``-``, before the right one; then the right one again."""
    count = row.draws.below(F.size(row.wrong) + 1, "count")
    chosen = F.slice(row.draws.shuffled(row.wrong, "shuffle"), F.lit(1), count)
    tried = F.flatten(
        F.transform(chosen, lambda j: F.concat(F.element_at(row.wrong, j + 1), row.one("-")))
    )
    told = F.concat(row.one("<"), tried, row.target, row.one(">"), row.target)
    return let(told, lambda t: plain(row.head(), t))


def _step_eval_validation(row: Row) -> Column:
    """The first wrong path only, its first two tokens given in the prompt."""
    steps = F.concat(F.try_element_at(row.wrong, F.lit(1)), row.one("-"), row.target)

    def cut(s: Column) -> Column:
        rest = F.slice(s, F.lit(3), F.greatest(F.size(s) - 2, F.lit(0)))
        return plain(
            F.concat(row.head(), row.one("<"), F.slice(s, 1, 2)),
            F.concat(rest, row.one(">"), row.target),
        )

    return let(steps, cut)


Builder = Callable[[Row], Column]

TRAIN: dict[str, dict[str, Builder]] = {
    "v1": {
        "teacherforcing": _teacherforcing,
        "reverse": _teacherforcing,
        "teacherless": _teacherless,
        "noisyguide": _noisyguide,
        "noisytarget": _noisytarget,
        "mixtask": _mixtask_v1,
        "fit_prefix": _fit_prefix,
        "improving": lambda row: _improving(row, keep_all=False),
        "error_detection": _error_detection,
        "step_eval": _step_eval,
        "step_eval_short": _step_eval,
        "pause": _teacherforcing,
    },
    "v0": {
        "teacherforcing": _teacherforcing,
        "reverse": _teacherforcing,
        "teacherless": _teacherless,
        "noisyguide": _noisyguide,
        "noisytarget": _noisytarget,
        "mixtask": _mixtask_v0,
    },
}
VALIDATION: dict[str, dict[str, Builder]] = {
    "v1": {
        "mixtask": _mixtask_v1_validation,
        "improving": lambda row: _improving(row, keep_all=True),
        "error_detection": _error_detection_validation,
        "step_eval": _step_eval_validation,
    },
    "v0": {"mixtask": _mixtask_v0},
}
NEEDS_WRONG_PATH = ("error_detection", "step_eval", "step_eval_short")


def reverse_list(text: Column) -> Column:
    """A comma list read backwards."""
    return F.array_join(F.reverse(F.split(text, ",", -1)), ",")


def encoded_rows(df: DataFrame, objective: str, opts: PrepOptions, split: str = "train") -> DataFrame:
    """Split and encode accepted lines: row id, ``_p``, ``_t`` and, where needed, ``_w``."""
    accepted, _ = split_prompt_target(df, opts.text_column, "=")
    target = reverse_list(F.col("target")) if objective == "reverse" else F.col("target")
    columns = {"_p": encode(F.col("prompt"), opts.vocab), "_t": encode(target, opts.vocab)}
    if _needs_wrong_path(objective, split):
        wrong = F.col("wrong_path")
        if not isinstance(df.schema["wrong_path"].dataType, ArrayType):
            wrong = F.array(wrong)
        columns["_w"] = F.transform(wrong, lambda w: encode(w, opts.vocab))
    return computed_once(accepted, **columns).select(opts.row_id, *columns)


def _needs_wrong_path(objective: str, split: str) -> bool:
    """Validation rows for error detection take their errors from the nodes of the prompt."""
    return objective in NEEDS_WRONG_PATH and (split == "train" or objective != "error_detection")


def _row(objective: str, opts: PrepOptions, split: str = "train") -> Row:
    wrong = F.col("_w") if _needs_wrong_path(objective, split) else None
    draws = Draws(opts.seed, F.col(opts.row_id))
    return Row(F.col("_p"), F.col("_t"), wrong, draws, opts.vocab, opts)


def _known(objective: str, opts: PrepOptions) -> None:
    known = OBJECTIVES_V1 + ("step_eval_short",) if opts.variant == "v1" else OBJECTIVES_V0
    if objective not in known:
        raise ValueError(f"unknown objective for {opts.variant}: {objective}")
    if objective == "noisyguide" and opts.alter_label:
        raise ValueError("noisyguide cannot alter labels")


def _complete(objective: str, split: str) -> Column:
    """Whether an encoded row has every part its objective needs: null paths make null arrays."""
    here = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    if objective in ("step_eval", "step_eval_short"):
        if split == "train":
            return here & F.col("_w").isNotNull() & ~F.exists("_w", lambda w: w.isNull())
        return here & F.try_element_at("_w", F.lit(1)).isNotNull()
    return here


def train_examples(df: DataFrame, objective: str, opts: PrepOptions) -> DataFrame:
    """``row id, input_ids, attention_mask, labels``; the "v1" form ends with the end token."""
    _known(objective, opts)
    rows = encoded_rows(df, objective, opts).filter(_complete(objective, "train"))
    made = rows.select(
        F.col(opts.row_id), TRAIN[opts.variant][objective](_row(objective, opts)).alias("_x")
    )
    end = [ints(opts.vocab.eos_id)] if opts.variant == "v1" else []
    return made.select(
        F.col(opts.row_id),
        F.concat(F.col("_x.prompt"), F.col("_x.given"), *end).alias("input_ids"),
        F.concat(masked(F.col("_x.prompt")), F.col("_x.labels"), *end).alias("labels"),
    ).select(
        opts.row_id, "input_ids", ones(F.col("input_ids")).alias("attention_mask"), "labels"
    )


def pad_target(target: Column, length: int, eos_id: int) -> Column:
    """Fill up with the end token to ``length``, then one more; longer targets are not cut."""
    return F.concat(target, repeat(eos_id, F.lit(length) - F.size(target)), ints(eos_id))


def validation_examples(
    df: DataFrame, objective: str, opts: PrepOptions, max_target_len: int | None = None
) -> DataFrame:
    """``row id, input_ids, attention_mask, targets``; ``input_ids`` holds the prompt only."""
    _known(objective, opts)
    row = _row(objective, opts, "validation")
    build = VALIDATION[opts.variant].get(objective, _teacherforcing)
    rows = encoded_rows(df, objective, opts, "validation")
    if opts.variant == "v1":
        rows = rows.filter(_complete(objective, "validation"))
    if opts.variant == "v1" and objective == "error_detection":
        rows = rows.filter(_error_detection_possible(row))
    made = rows.select(F.col(opts.row_id), build(row).alias("_x"))
    targets = F.col("_x.labels")
    if opts.variant == "v1":
        if max_target_len is None:
            raise ValueError("validation examples need max_target_len")
        targets = pad_target(targets, max_target_len, opts.vocab.eos_id)
    return made.select(
        F.col(opts.row_id), F.col("_x.prompt").alias("input_ids"), targets.alias("targets")
    ).select(
        opts.row_id, "input_ids", ones(F.col("input_ids")).alias("attention_mask"), "targets"
    )


def examples(
    df: DataFrame,
    objective: str,
    opts: PrepOptions,
    split: str,
    max_target_len: int | None = None,
) -> DataFrame:
    """Examples of one split ("train" or "validation")."""
    if split == "train":
        return train_examples(df, objective, opts)
    return validation_examples(df, objective, opts, max_target_len)


def rejected(df: DataFrame, objective: str, opts: PrepOptions, split: str) -> DataFrame:
    """Rows :func:`examples` leaves out, as ``row id, reason``."""
    _, rejects = split_prompt_target(df, opts.text_column, "=")
    out = rejects.select(opts.row_id, F.lit("parts").alias("reason"))
    rows = encoded_rows(df, objective, opts, split)
    whole = F.coalesce(_complete(objective, split), F.lit(False))
    if split == "train" or opts.variant == "v1":
        out = out.unionByName(rows.filter(~whole).select(opts.row_id, F.lit("wrong_path").alias("reason")))
    if opts.variant == "v1" and objective == "error_detection" and split != "train":
        bad = rows.filter(whole & ~_error_detection_possible(_row(objective, opts, split)))
        out = out.unionByName(bad.select(opts.row_id, F.lit("target").alias("reason")))
    return out


def generation_examples(df: DataFrame, opts: PrepOptions) -> DataFrame:
    """Prompts with unpadded ``targets`` for generation, the same on every split."""
    return encoded_rows(df, "teacherforcing", opts).select(
        F.col(opts.row_id),
        F.col("_p").alias("input_ids"),
        ones(F.col("_p")).alias("attention_mask"),
        F.col("_t").alias("targets"),
    )


def target_lengths(*parts: DataFrame, column: str = "len_target") -> DataFrame:
    """The longest target over all splits, as one row ``max_target_length``: one aggregate over
    the stored lengths."""
    lengths = parts[0].select(column)
    for part in parts[1:]:
        lengths = lengths.unionAll(part.select(column))
    return lengths.agg(F.max(column).cast("bigint").alias("max_target_length"))


def max_target_length(*parts: DataFrame, column: str = "len_target") -> int:
    """The value of :func:`target_lengths`; runs the aggregate."""
    return target_lengths(*parts, column=column).first()[0]
