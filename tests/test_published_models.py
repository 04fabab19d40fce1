"""Models between fit and store."""

from __future__ import annotations

import weakref


def test_fitted_models_are_let_go_before_the_published_ones_are_loaded(monkeypatch):
    from catalog import job_queries as Q

    class Fitted:
        pass

    class Session:
        sparkContext = type("Context", (), {"applicationId": "one fit"})

    alive, loads = [], []

    def fit(*_):
        model = Fitted()
        alive.append(weakref.ref(model))
        return {("pm25", "Forest"): model}, "metrics"

    def published(*_):
        loads.append([r() is not None for r in alive])
        return ({("pm25", "Forest"): "loaded"}, "metrics") if alive else None

    monkeypatch.setattr(Q.A, "raw_long", lambda *_: None)
    monkeypatch.setattr(Q, "stored_features", lambda *_: None)
    monkeypatch.setattr(Q, "store_root", lambda *_: "root")
    monkeypatch.setattr(Q, "staged", lambda df, _: df)
    monkeypatch.setattr(Q.training, "train_and_evaluate", fit)
    for name, found in (("fingerprint", lambda _: "table"), ("publish", lambda *_: None), ("published", published)):
        monkeypatch.setattr(Q.store, name, found)
    assert Q.trained(Session, "sf", ("Forest",)) == ({("pm25", "Forest"): "loaded"}, "metrics")
    assert loads == [[], [False]]


def test_the_feature_table_is_written_once_for_fit_and_test_rows(monkeypatch):
    from catalog import QUERIES, registry
    from catalog import job_queries as Q

    class Session:
        sparkContext = type("Context", (), {"applicationId": "one table"})
        conf = type("Conf", (), {"set": lambda *_: None})

    asked, handed = [], []
    monkeypatch.setattr(Q.A, "raw_long", lambda *_: None)
    monkeypatch.setattr(Q, "stored_features", lambda *_: asked.append(1) or "features")
    monkeypatch.setattr(Q, "store_root", lambda *_: "root")
    monkeypatch.setattr(Q, "staged", lambda df, _: df)
    monkeypatch.setattr(Q.evaluate, "time_split", lambda table: (None, table, None))
    monkeypatch.setattr(Q.training, "train_and_evaluate", lambda table, *_: handed.append(table) or ({}, "metrics"))
    monkeypatch.setattr(Q.training, "predictions", lambda test, _: test)
    for name, found in (("fingerprint", lambda _: "table"), ("publish", lambda *_: None), ("published", lambda *_: ({}, "metrics") if handed else None)):
        monkeypatch.setattr(Q.store, name, found)
    monkeypatch.setattr(registry, "snapped", lambda df: df)
    assert QUERIES["model_store"](Session, "sf") == "features"
    assert asked == [1] and handed == ["features"]
