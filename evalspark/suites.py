"""Suite registry: everything that differs between evaluation suites.

A suite is a set of hooks: Column builders for the post-processing in each
mode, the stop rule of streamed output, the reducer of execution facts to
verdicts and the builder of the metric report, beside the flag list and the
k / t grids.  ``plans/evaluate.py`` reads the hooks and knows no suite by name, so
a new suite is an entry here, or a ``register_suite`` call anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import braces, defect, text
from evalspark.operators import reports
from evalspark.operators import verdicts as ver
from evalspark.schemas import TEST_VERDICT_FLAGS, VERDICT_FLAGS

# Sample-count grid and token budgets of the metric reports.
K_GRID_COMPLETE = [1, 5, 10, 20, 50, 100]
K_GRID_DEFAULT = [1, 5, 10, 20, 100]
T_GRID = [1000, 5000, 10000, 20000, 500000, 1000000]


#: The cleaned text of a sample from the column ``output`` and the suite's task columns.
Builder = Callable[["SuiteConfig"], Column]
#: Verdicts per sample from run facts, the sample key and, where there is one, a coverage table.
Reducer = Callable[[DataFrame, list[str], "DataFrame | None"], DataFrame]


def complete_function(cfg: SuiteConfig) -> Column:
    """The output behind the prompt, up to where its first function body closes."""
    return braces.stop_at_function(text.drop_prompt_prefix(F.col("output"), F.col(cfg.complete_prefix_col)))


def chat_function(cfg: SuiteConfig) -> Column:
    """The function of the task's signature, cut out of the answer."""
    return text.extract_chat_function(F.col("output"), F.col("function_signature"), cfg.strip_signature)


def complete_answer(cfg: SuiteConfig) -> Column:
    return defect.truncate_defect_answer(text.drop_prompt_prefix(F.col("output"), F.col(cfg.complete_prefix_col)))


def chat_answer(cfg: SuiteConfig) -> Column:
    return defect.truncate_defect_answer(F.col("output"))


def stop_by_mode(mode: str) -> str:
    """Complete mode scans behind the signature, chat mode waits for it."""
    return {"complete": "signature", "chat": "chat"}[mode]


def _stop_by(scan: str) -> Callable[[str], str]:
    return stop_by_mode if scan == "signature" else lambda mode: scan


def patch_verdict(steps: DataFrame, keys: list[str], coverage: DataFrame | None = None) -> DataFrame:
    return ver.reduce_patch_verdict(steps, keys)


def testgen_verdict(steps: DataFrame, keys: list[str], coverage: DataFrame | None = None) -> DataFrame:
    return ver.reduce_testgen_verdict(steps, keys)


def issue_verdict(steps: DataFrame, keys: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """Twin runs; coverage from the fixed version's step, unless ``coverage`` brings it."""
    return ver.issue_verdict_from_facts(steps, keys, coverage)


@dataclass(frozen=True)
class SuiteConfig:
    name: str
    complete_prefix_col: str | None = None      # column whose length is cut from complete-mode output
    chat_extraction: str = "signature"          # "signature" or "marker": which hooks are taken where none are given
    strip_signature: bool = False               # strip the signature before cleaning it
    flags: tuple = ()
    k_grid: tuple = tuple(K_GRID_DEFAULT)
    t_grid: tuple = tuple(T_GRID)
    has_coverage: bool = False
    twin_versions: bool = False
    stream_scan: str = "signature"              # "signature", "text" or "marker"
    reference_col: str = "function"             # column holding the reference solution
    task_columns: tuple = ()                    # more task columns that the builders read
    complete: Builder | None = None
    chat: Builder | None = None
    stop_rule: Callable[[str], str] | None = None
    verdict: Reducer | None = None
    report: Callable[..., reports.EvalReport] | None = None

    def __post_init__(self):
        answers = self.chat_extraction == "marker"
        defaults = {
            "complete": complete_answer if answers else complete_function,
            "chat": chat_answer if answers else chat_function,
            "stop_rule": _stop_by(self.stream_scan),
            "verdict": issue_verdict if self.twin_versions else testgen_verdict if self.has_coverage else patch_verdict,
            "report": reports.defect_report if answers else reports.pass_report,
        }
        for hook, default in defaults.items():
            if getattr(self, hook) is None:
                object.__setattr__(self, hook, default)

    def cleaned(self, mode: str) -> Column:
        if mode == "complete":
            return self.complete(self)
        if mode == "chat":
            return self.chat(self)
        raise NotImplementedError(mode)


_REGISTRY: dict[str, SuiteConfig] = {}


def register_suite(cfg: SuiteConfig) -> SuiteConfig:
    _REGISTRY[cfg.name] = cfg
    return cfg


def get_suite(name: str) -> SuiteConfig:
    """Registry lookup; an unknown name raises ``KeyError``."""
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"unknown suite {name!r}; known: {sorted(_REGISTRY)}") from None


def suite_names() -> list[str]:
    return sorted(_REGISTRY)


register_suite(SuiteConfig("complete", "prompt_complete_with_comment", "signature", True,
                           tuple(VERDICT_FLAGS), tuple(K_GRID_COMPLETE)))
register_suite(SuiteConfig("repair", "prompt_complete", "signature", True,
                           tuple(VERDICT_FLAGS), stream_scan="text", reference_col="fix"))
register_suite(SuiteConfig("testgen", "prompt_complete_with_comment", "signature", False,
                           tuple(TEST_VERDICT_FLAGS), has_coverage=True))
register_suite(SuiteConfig("testgenissue", "prompt_complete_without_signature", "signature", False,
                           tuple(TEST_VERDICT_FLAGS), has_coverage=True, twin_versions=True))
register_suite(SuiteConfig("defectdetection", "prompt_complete", "marker", False,
                           (), (), (), stream_scan="marker", reference_col="fix"))
