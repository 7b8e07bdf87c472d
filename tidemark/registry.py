"""Names for pluggable parts, and the command-line form of nested options: `name -k value -l (name -x 1)`."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from tidemark import flows, protocols, tasks
from tidemark.operators import drift, evaluation, forest, hoeffding, micro, observers, online, rules, rulesets
from tidemark.sources import arff, generators


class Measured:
    """An evaluator made of a function and its options."""

    def __init__(self, of: Callable, **options):
        self.of, self.options = of, options

    def measure(self, df, order, y, pred):
        return self.of(df, order, y, pred, **self.options)


def _over(make: Callable) -> Callable:
    """Ensembles and adaptive learners over a learner that is named in their options: -l (tree -grace 50)."""

    def made(classes: int = 2, models: int = 10, l: tuple = ("tree", {}), d: tuple = ("adwin", {})):  # noqa: E741
        base = lambda: _made("learner", *l, {"classes": classes})
        return make(base, classes, models, lambda: _made("detector", *d, {}))

    return made


#: What can be named, by kind; `register` adds to it.
KINDS: dict[str, dict[str, Callable]] = {
    "detector": {"ddm": drift.ddm, "eddm": drift.eddm, "page_hinkley": drift.page_hinkley, "cusum": drift.cusum, "geometric": drift.geometric, "ewma": drift.ewma, "ph_test": drift.ph_test, "rising": drift.rising, "adwin": drift.adwin},
    "criterion": {"info_gain": lambda: hoeffding.info_gain, "gini": lambda: hoeffding.gini_gain},
    "stream": {"random_tree": generators.random_tree, "hyperplane": generators.hyperplane},
    "source": {"greetings": flows.Greetings, "table": flows.Table},
    "reader": {"arff": arff.read},
    "clusterer": {"clustream": micro.clustream, "distributed": micro.distributed},
    "learner": {
        "majority": online.Majority, "bayes": online.NaiveBayes, "tree": online.Tree, "bagging": _over(lambda base, classes, models, detector: online.Bagging(base, models, classes)),
        "boosting": _over(lambda base, classes, models, detector: online.Boosting(base, models, classes)), "adaptive": _over(lambda base, classes, models, detector: online.Adaptive(base, detector())),
        "adaptive_bagging": _over(lambda base, classes, models, detector: online.Bagging(lambda: online.Adaptive(base, detector()), models, classes)),
    },
    "regressor": {"rules": online.Rules},
    "forest": {
        "single": lambda classes, **o: forest.Forest(classes, **o), "bagging": lambda classes, **o: forest.Forest(classes, **({"kind": "bagging", "models": 10} | o)), "boosting": lambda classes, **o: forest.Forest(classes, **({"kind": "boosting", "models": 10} | o)),
        "adaptive": lambda classes, detector=("rising", {}), **o: forest.Forest(classes, **({"kind": "adaptive", "models": 10, "detector": _made("detector", *detector, {})} | o)),
    },
    "rule_set": {"rules": rulesets.RuleSet},
    "evaluator": {"classification": lambda **o: Measured(evaluation.classification, **o), "window": lambda **o: Measured(evaluation.classification, **({"width": 1000} | o)), "regression": lambda **o: Measured(evaluation.regression, **o)},
    "observer": {"bins": observers.Bins, "quantiles": observers.Quantiles, "moments": observers.LimitedMoments, "nothing": observers.Nothing},
    "vote": {"inverse_error": lambda: rules.inverse_error_vote, "uniform": lambda: rules.uniform_vote},
    "task": {"prequential": lambda **o: partial(tasks.prequential, **o), "clustering": lambda **o: partial(tasks.clustering_evaluation, **o), "clustering_horizons": lambda **o: partial(tasks.clustering_horizons, **o), "hello_world": flows.hello_world},
}

#: What a part of a kind must offer, where that is more than being made.
SHAPES = {"learner": protocols.Learner, "regressor": protocols.Learner, "source": protocols.Source, "evaluator": protocols.Evaluator}


def register(kind: str, name: str, make: Callable) -> None:
    KINDS.setdefault(kind, {})[name] = make


def create(kind: str, text: str, **defaults) -> Any:
    """The part that a command line names: `bagging -models 5 -l (tree -grace 50)`."""
    return _made(kind, *parse(text), defaults)


def _made(kind: str, name: str, options: dict, defaults: dict) -> Any:
    if name not in KINDS.get(kind, {}):
        raise KeyError(f"no {kind} is called {name!r}; there are {sorted(KINDS.get(kind, {}))}")
    part = KINDS[kind][name](**(defaults | options))
    return protocols.check(part, SHAPES[kind]) if kind in SHAPES else part


def parse(text: str) -> tuple[str, dict[str, Any]]:
    """The name and options of a command line; nested ones in brackets become (name, options)."""
    parts, depth, word = [], 0, ""
    for c in text.strip():
        if c == " " and not depth:
            if word:
                parts.append(word)
            word = ""
            continue
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError(f"unbalanced brackets in {text!r}")
        word += c
    if depth:
        raise ValueError(f"unbalanced brackets in {text!r}")
    parts += [word] if word else []
    if not parts:
        raise ValueError("an empty command line")
    options: dict[str, Any] = {}
    at = 1
    while at < len(parts):
        if not parts[at].startswith("-") or _number(parts[at]) is not None:
            raise ValueError(f"{parts[at]!r} is not an option")
        key = parts[at].lstrip("-").replace("-", "_")
        if at + 1 < len(parts) and (not parts[at + 1].startswith("-") or _number(parts[at + 1]) is not None):
            value = parts[at + 1]
            options[key] = parse(value[1:-1]) if value.startswith("(") else value if _number(value) is None else _number(value)
            at += 2
        else:
            options[key] = True
            at += 1
    return parts[0], options


def _number(text: str) -> int | float | None:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None
