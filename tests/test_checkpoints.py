"""A scan of checkpoints that passes over what it cannot use and says why."""

import json

from assaylake.operators import checkpoints


def record(run, **change):
    series = {"val_mse": [0.5, 0.4], "selection_score": [0.5, 0.375], "first_mse": [0.6, 0.5], "second_mse": [0.4, 0.25], "second_sd": [0.1, 0.1], "val_r2": [0.1], "val_loss": [0.7, 0.6], "val_epoch": [1, 5]}
    policy = {**checkpoints.POLICY, "uses_test": False, "uses_outcomes": False, "first_weight": 0.5, "second_weight": 0.5}
    out = {"run": run, "method": "m", "architecture": "a", "latent_dim": 8, "input_dim": 100, "epoch": 9, "best": 0.375, "history": series, "policy": policy}
    for key, value in change.items():
        part, _, field = key.partition("__")
        if field:
            out[part] = {**out[part], field: value}
        else:
            out[part] = value
    return out


def test_a_scan_goes_on_and_names_what_it_passes_over(spark, tmp_path):
    records = {
        "run_b": record("run_b", history__selection_score=[0.5, 0.3], history__first_mse=[0.6, 0.35], best=0.3), "run_a": record("run_a"), "run_c": record("run_c", best=0.376),
        "run_d": record("run_d", history__second_sd=[0.1]), "run_e": record("run_e", policy__uses_test=True), "run_f": record("run_f", history__val_mse=[]),
        "run_g": record("run_g", history__second_sd=[0.1, None]), "run_h": record("run_h", policy__metric="loss"), "run_i": record("run_i", history=None), "run_j": record("run_j", history__selection_score=[0.5, 0.4], best=0.4),
    }
    for name, value in records.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "best.json").write_text(json.dumps(value))
    (tmp_path / "run_z").mkdir()
    (tmp_path / "run_z" / "best.json").write_text('{"run": "run_z", "best"')
    found = checkpoints.scanned(checkpoints.read(spark, f"file://{tmp_path}")).cache()
    got = [(r.position, r.run, r.score, r.best_epoch, r.validation_r2, r.validation_loss) for r in checkpoints.ranked(found).orderBy("position").collect()]
    assert got == [(0, "run_b", 0.3, 5, None, 0.6), (1, "run_a", 0.375, 5, None, 0.6)]
    assert {r.path.split("/")[-2]: r.problem for r in checkpoints.warnings(found).collect()} == {
        "run_c": "scores disagree", "run_d": "another policy", "run_e": "another policy", "run_f": "no validation", "run_g": "not finite", "run_h": "another policy", "run_i": "no validation", "run_j": "scores disagree", "run_z": "unreadable",
    }
