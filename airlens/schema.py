"""Record layouts."""

from __future__ import annotations

STATE_FIELDS = (
    "icao24 string, callsign string, registration string, aircraft_type string, ts double, lat double, lon double, "
    "baro_alt_ft double, geo_alt_ft double, gs_kt double, track_deg double, vrate_fpm double, squawk string, "
    "on_ground boolean, emergency string, selected_alt_ft double, nic int, nac_p int, sil int, "
    "position_source string, source string"
)
BATCH = "ts double, provider string, region string, schema_version int, states array<struct<" + ", ".join(
    f"{f.split()[0]}: {f.split()[1]}" for f in STATE_FIELDS.split(", ")
) + ">>"
STATE_COLUMNS = [f.split()[0] for f in STATE_FIELDS.split(", ")]

# columns every operator on traffic may rely on, in front of the state columns
POLL_COLUMNS = ["recording", "batch_seq", "pos", "batch_ts", "prev_batch_ts", "region", "provider"]

EPHEMERIS = "norad int, t_idx int, ts double, x_km double, y_km double, z_km double, vx_kms double, vy_kms double, vz_kms double"
