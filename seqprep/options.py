"""Options of a preparation job and the checks on them, all before any plan is built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from seqprep.functions.tokens import Vocab, vocab_of

# ---- fixed values -------------------------------------------------------------------------
FILE_FORMATS = ("csv", "json", "txt")
OBJECTIVES_V1 = (
    "teacherforcing", "reverse", "teacherless", "noisyguide", "noisytarget", "mixtask",
    "fit_prefix", "improving", "error_detection", "step_eval", "pause",
)
OBJECTIVES_V0 = (
    "teacherforcing", "reverse", "teacherless", "noisyguide", "noisytarget", "mixtask",
)
LEGO_TASKS = ("path", "steps", "direct", "verify_steps")
AUGMENTATIONS = ("none", "padding")
SHORTEST_OBJECTIVES = ("teacherforcing", "step_eval", "pause")
DEFAULT_POSITIONS = 1024
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PrepOptions:
    """What one run does. ``variant`` "v1" is the pre-training form, "v0" the preference form."""

    dataset_name: str | None = None
    dataset_config: str | None = None
    load_from_disk: bool = False
    streaming: bool = False
    train_file: str | None = None
    validation_file: str | None = None
    validation_pct: int = 5
    keep_linebreaks: bool = True
    max_train_samples: int | None = None
    max_eval_samples: int | None = None
    overwrite_cache: bool = False
    block_size: int | None = None
    row_id: str = "id"
    text_column: str = "text"
    variant: str = "v1"
    objective: str = "teacherforcing"
    num_nodes: int = 50
    reverse: bool = False
    teacherless: bool = False
    noisy_target: float = 0.0
    alter_label: bool = False
    mixtask_ratio: float = 0.2
    task: str = "direct"
    aug: str = "none"
    seed: int = 42

    @property
    def vocab(self) -> Vocab:
        return vocab_of("numeral-v1" if self.variant == "v1" else "numeral-v0", self.num_nodes)

    def fingerprint(self) -> str:
        """A short key of all option values that decide a table, for reuse of prepared ones.

        Streams and batches make the same rows."""
        values = {k: v for k, v in asdict(self).items() if k not in ("overwrite_cache", "streaming")}
        text = json.dumps(values, sort_keys=True)
        return hashlib.md5(text.encode()).hexdigest()[:16]


def file_format(path: str) -> str:
    extension = path.rsplit(".", 1)[-1]
    if extension not in FILE_FORMATS:
        raise ValueError(f"{path!r} is none of {', '.join(FILE_FORMATS)}")
    return extension


def validate_options(opts: PrepOptions) -> PrepOptions:
    """Raise ``ValueError`` on options that do not fit together; return them otherwise."""
    if opts.dataset_name is None and opts.train_file is None and opts.validation_file is None:
        raise ValueError("need a dataset name or a train or validation file")
    if opts.dataset_name is None:
        for path in (opts.train_file, opts.validation_file):
            if path is not None:
                file_format(path)
    if opts.teacherless and opts.reverse:
        raise ValueError("teacherless excludes reverse")
    if opts.teacherless and opts.noisy_target > 0:
        raise ValueError("teacherless excludes target noise")
    if opts.reverse and opts.noisy_target > 0:
        raise ValueError("reverse excludes target noise")
    if opts.variant not in ("v1", "v0"):
        raise ValueError(f"unknown variant: {opts.variant}")
    allowed = OBJECTIVES_V1 if opts.variant == "v1" else OBJECTIVES_V0
    if opts.objective not in allowed:
        raise ValueError(f"unknown objective: {opts.objective}")
    if opts.objective == "noisyguide" and opts.alter_label:
        raise ValueError("noisyguide cannot alter labels")
    if opts.task not in LEGO_TASKS:
        raise ValueError(f"unknown task: {opts.task}")
    if opts.aug not in AUGMENTATIONS:
        raise ValueError(f"unknown augmentation: {opts.aug}")
    return opts


def block_size(
    option: int | None, tokenizer_max: int, position_limit: int | None = None
) -> int:
    """Chunk length for packing.

    A given option is bounded by the tokeniser. Without one the tokeniser's own limit is used,
    unless it goes beyond the model's position limit: then 1024 or that limit, whichever is less
    (1024 when the limit is not positive). ``position_limit=None`` is a model that has none.
    """
    if option is not None:
        return min(option, tokenizer_max)
    limit = DEFAULT_POSITIONS if position_limit is None else position_limit
    if tokenizer_max <= limit:
        return tokenizer_max
    return min(DEFAULT_POSITIONS, limit) if limit > 0 else DEFAULT_POSITIONS
