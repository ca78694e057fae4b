"""Every grouped-training query trains on the tables as they are."""

from vitalgrid.plans import q_grouped as Q


def test_experiment_trains_anew_for_every_query(spark, monkeypatch):
    columns = ", ".join([f"1 {Q.E}", "1 event_id", *[f"0.0 {c}" for c in Q.COLS14], f"1 {Q.Y}"])
    rows = spark.sql(f"SELECT {columns}")
    runs = []

    def train(*args, **kwargs):
        runs.append(1)
        return {"params": {}, "global": dict.fromkeys(Q.SEEDS), "history": {s: [] for s in Q.SEEDS}, "n_in": 14}

    monkeypatch.setattr(Q, "train_test", lambda *a, **k: (rows, rows))
    monkeypatch.setattr(Q, "materialize", lambda df, name: df)
    monkeypatch.setattr(Q.SP, "standardise", lambda a, b, cols: (a, b))
    monkeypatch.setattr(Q.GR, "train_grouped", train)
    monkeypatch.setattr(Q.GR, "score_models", lambda *a, **k: None)
    monkeypatch.setattr(Q.M, "model_table", lambda *a: spark.sql(
        f"SELECT '42|central|0' model, {len(runs)} / 10 auroc, 0.5 prauc"))
    for n in (1, 2):
        _, _, parsed = Q.experiment(spark, "some path")
        assert len(runs) == n and float(parsed.first()["auroc"]) == n / 10
