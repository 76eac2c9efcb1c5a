"""Every limit the rules use, in one frozen object that is bound as literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    max_plausible_gs_kt: float = 750.0
    gs_mismatch_kt: float = 150.0
    mlat_factor: float = 2.5
    tisb_factor: float = 2.0
    asterix_factor: float = 1.5
    min_dt_kinematics_s: float = 4.0
    min_nic: int = 7
    min_nac_p: int = 8
    min_sil: int = 3
    max_vrate_fpm: float = 6000.0
    max_implied_vrate_fpm: float = 8000.0
    vrate_mismatch_fpm: float = 4000.0
    min_dt_vrate_s: float = 10.0
    hold_min_fixes: int = 8
    hold_heading_deg: float = 300.0
    hold_max_net_nm: float = 8.0
    hold_min_alt_ft: float = 3000.0
    hold_min_gs_kt: float = 150.0
    alt_dev_ft: float = 300.0
    alt_dev_min_alt_ft: float = 3000.0
    level_vrate_fpm: float = 300.0
    alt_dev_preselect_ft: float = 1000.0
    alt_dev_min_fixes: int = 3
    alt_dev_min_persist_s: float = 60.0
    stale_contact_s: float = 90.0
    class_a_floor_ft: float = 18000.0
    identity_floor_ft: float = 10000.0
    duplicate_min_sep_nm: float = 5.0
    prox_lateral_nm: float = 3.0
    prox_vertical_ft: float = 900.0
    prox_min_alt_ft: float = 3000.0
    prox_close_nm: float = 1.5
    prox_close_ft: float = 600.0
    prox_max_age_s: float = 60.0
    burst_min_new: int = 25
    burst_factor: float = 4.0
    collapse_fraction: float = 0.5
    collapse_min_baseline: float = 20.0
    history_batches: int = 8
    history_min: int = 3
    track_window: int = 12
    track_max_age_s: float = 600.0
    ml_min_flags: int = 2
    ml_flag_window_s: float = 600.0
    cooldown_s: float = 120.0

    def override(self, changes: dict[str, dict[str, float]] | dict[str, float]) -> Thresholds:
        """New thresholds from ``{name: value}`` (or grouped ``{group: {name: value}}``); unknown names raise."""
        flat: dict[str, float] = {}
        for k, v in changes.items():
            flat.update(v if isinstance(v, dict) else {k: v})
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        unknown = sorted(set(flat) - set(known))
        if unknown:
            raise KeyError(f"unknown threshold(s): {', '.join(unknown)}")
        return replace(self, **{k: known[k](v) for k, v in flat.items()})


DEFAULT = Thresholds()

# fixed values: seconds between two findings of one rule for one aircraft
COOLDOWN_S = {
    "OPS-001": 900.0,
    "OPS-002": 600.0,
    "OPS-003": 900.0,
    "OPS-004": 600.0,
    "SEC-012": 900.0,
    "SEC-013": 900.0,
    "OPS-005": 900.0,
    "ML-001": 300.0,
    "SAF-004": 300.0,
}
