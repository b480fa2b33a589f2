"""evalspark: Spark-native analytics for code-generation evaluation runs.

Tables of tasks, sampled outputs, run facts and coverage reports go in;
post-processed samples, verdicts and pass@k / pass@t / coverage / defect
metrics come out.  Everything is expressed with the DataFrame API so that
Catalyst and AQE plan it; Python workers only appear in the stateful
streaming operators and in an optional tokenizer plug-in.

Main entry points::

    from evalspark import build_session, get_suite, run_evaluate, evaluate_files
"""

from evalspark.session import build_session, checkpoint_root, scratch_path
from evalspark.suites import SuiteConfig, get_suite, register_suite


def __getattr__(name):
    # Plan-level entry points load lazily (they pull in every operator module).
    if name in ("run_evaluate", "evaluate_files", "score", "verdicts_from_facts"):
        from evalspark.plans import evaluate
        return getattr(evaluate, name)
    if name in ("build_requests", "reorg_output_file"):
        from evalspark.plans import generation
        return getattr(generation, name)
    raise AttributeError(name)


__all__ = ["build_session", "checkpoint_root", "scratch_path", "SuiteConfig", "get_suite", "register_suite",
           "run_evaluate", "evaluate_files", "score", "verdicts_from_facts", "build_requests", "reorg_output_file"]
