"""What the registered queries hand to the searches and strategies."""

from __future__ import annotations

from types import SimpleNamespace

from weekcast.catalog import modelling
from weekcast.operators import models
from weekcast.plans import strategy


def test_all_shipped_strategies_are_run_as_declared(monkeypatch):
    """None left out, none smaller than shipped."""
    run = []
    monkeypatch.setattr(strategy, "strategy_frame", lambda panel, strategies, spec: panel)
    monkeypatch.setattr(strategy, "fit_predict_strategy", lambda frame, s, spec, weeks: run.append(s) or Parts())
    monkeypatch.setattr(strategy, "strategy_metrics", lambda forecasts: forecasts)
    modelling.run_all_strategies(SimpleNamespace(sales_table=None))
    assert tuple(run) == strategy.STRATEGIES
    trees = [m.params["n_estimators"] for s in run for _, m in s.models.values() if "n_estimators" in m.params]
    assert len(run) == 5 and min(trees) == 500 and max(trees) == 1500


class Parts:
    def unionByName(self, other):
        return self


def test_tune_searches_the_whole_space(monkeypatch):
    """100 trials, every parameter of the space in its whole range, each over all folds of the frame."""
    tried = []
    monkeypatch.setattr(modelling, "learning", lambda t: (Frame(), ["a"]))
    monkeypatch.setattr(models, "oof_predictions", lambda frame, features, specs, spec, gap: tried.append(specs["prediction"]))
    monkeypatch.setattr(models, "metrics", lambda *args: SimpleNamespace(head=lambda: {"wmape": 1.0}))
    modelling.tune(None)
    assert len(tried) == 100 and {m.kind for m in tried} == {"gbt"}
    for name, (low, high) in models.SEARCH_SPACE.items():
        values = [m.params[name] for m in tried]
        assert min(values) < low + (high - low) / 5 and max(values) > high - (high - low) / 5


class Frame:
    """Where the table of trials goes."""

    sparkSession = property(lambda self: self)

    def createDataFrame(self, rows, columns):
        return self

    def orderBy(self, *columns):
        return self
