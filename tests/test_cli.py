"""The command-line steps keep the original exit-code gates."""

from __future__ import annotations

import os

from panelforge import cli

from . import fixtures as FX


def test_cli_steps_and_exit_codes(spark, tmp, capsys):
    live, frozen = FX.write_live(os.path.join(tmp, "a.csv")), FX.write_frozen(os.path.join(tmp, "b.csv"))
    wh = os.path.join(tmp, "wh")
    assert cli.main(["validate", "--live", live, "--frozen", frozen]) == 0
    assert "live file order: descending" in capsys.readouterr().out
    assert cli.main(["splice", "--live", live, "--frozen", frozen]) == 0
    assert "identical overlap: True" in capsys.readouterr().out
    assert cli.main(["load", "--live", live, "--frozen", frozen, "--warehouse", wh, "--verify"]) == 0
    assert cli.main(["metrics", "--warehouse", wh]) == 0
    assert cli.main(["metrics", "--warehouse", wh, "--check-anchors"]) == 1   # fixture values are not the real ones
    assert cli.main(["refresh", "--live", live, "--frozen", frozen, "--warehouse", wh]) == 0   # unchanged
    ahead = FX.write_live(os.path.join(tmp, "next.csv"), rows=[FX.live_row(2026, 5)] + FX.live_rows())
    args = ["refresh", "--live", ahead, "--frozen", frozen, "--warehouse", wh]
    assert cli.main(args) == 1 and cli.main(args) == 1   # anchors stop it, and stop the next try as well
    assert cli.main([*args, "--no-anchors"]) == 0
    rows = FX.live_rows()
    rows[2][3] = " "
    blank = FX.write_live(os.path.join(tmp, "blank.csv"), rows=rows)
    assert cli.main(["load", "--live", blank, "--frozen", frozen, "--warehouse", os.path.join(tmp, "none")]) == 1
    assert not os.path.exists(os.path.join(tmp, "none"))
    rows[2][3] = "-5"
    bad = FX.write_live(os.path.join(tmp, "bad.csv"), rows=rows)
    assert cli.main(["validate", "--live", bad, "--frozen", frozen]) == 1
