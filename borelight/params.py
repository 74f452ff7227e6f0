"""Default thresholds, word lists and lookup tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# They must equal the published ones for results to agree.

SENTINELS = (-999.25, -999.0, -9999.0)

# source unit -> (canonical unit, scale, offset)
UNIT_RULES = {
    "N": ("kN", 1e-3, 0.0),
    "N.m": ("kN.m", 1e-3, 0.0),
    "Pa": ("bar", 1e-5, 0.0),
    "m3/s": ("L/min", 60000.0, 0.0),
    "c/s": ("rpm", 60.0, 0.0),
    "Hz": ("spm", 60.0, 0.0),
    "K": ("degC", 1.0, -273.15),
    "kg/m3": ("s.g.", 1e-3, 0.0),
    "m/s": ("m/h", 3600.0, 0.0),
    "J": ("kJ", 1e-3, 0.0),
}
KNOWN_PLAIN_UNITS = ("m", "s", "unitless", "ohm.m", "m3", "A", "Euc", "%", "")

LITHOLOGY_NAMES = {
    30000: "Sandstone",
    65030: "Sandstone/Shale",
    65000: "Shale",
    80000: "Marl",
    74000: "Dolomite",
    70000: "Limestone",
    70032: "Chalk",
    88000: "Halite",
    86000: "Anhydrite",
    99000: "Tuff",
    90000: "Coal",
    93000: "Basement",
}

LOG_CURVES = ("GR", "RHOB", "NPHI", "DTC", "RDEP", "RMED", "CALI", "PEF", "SP", "DRHO")

LOG_TEXT_COLUMNS = ("WELL", "GROUP", "FORMATION")
LOG_NUMBER_COLUMNS = (
    "DEPTH_MD", "X_LOC", "Y_LOC", "Z_LOC", "CALI", "RSHA", "RMED", "RDEP", "RHOB", "GR", "SGR",
    "NPHI", "PEF", "DTC", "SP", "BS", "ROP", "DTS", "DCAL", "DRHO", "MUDWEIGHT", "RMIC", "ROPA", "RXO",
)
LOG_FILE_ORDER = (
    "WELL", "DEPTH_MD", "X_LOC", "Y_LOC", "Z_LOC", "GROUP", "FORMATION", "CALI", "RSHA", "RMED",
    "RDEP", "RHOB", "GR", "SGR", "NPHI", "PEF", "DTC", "SP", "BS", "ROP", "DTS", "DCAL", "DRHO",
    "MUDWEIGHT", "RMIC", "ROPA", "RXO",
    "FORCE_2020_LITHOFACIES_LITHOLOGY", "FORCE_2020_LITHOFACIES_CONFIDENCE",
)

CHANNEL_MAP = {
    "hole_depth_m": ("Depth", "MDEPTH"),
    "bit_depth_m": ("BITDEP",),
    "rop_m_per_hr": ("ROP_AVG",),
    "weight_on_bit_kn": ("WOB_AVG", "WOB"),
    "surface_torque_knm": ("TORQUE_AVG",),
    "surface_rpm": ("SURF_RPM",),
    "bit_rpm": ("BIT_RPM_AVG", "BIT_RPM"),
    "standpipe_pressure_bar": ("PUMP", "PUMP2"),
    "flow_in_lpm": ("FLOWIN",),
    "flow_out_lpm": ("FLOWOUT",),
    "hookload_kn": ("HKLD_AVG", "HKLD"),
    "mse_bar": ("MSE", "I_MSE"),
    "mud_weight_in_sg": ("MWIN",),
    "mud_weight_out_sg": ("MWOUT",),
    "pit_gain_loss_m3": ("GAINLOSSTOT",),
    "total_gas": ("TOTGAS",),
    "mud_temp_in_c": ("MTIN",),
    "mud_temp_out_c": ("MTOUT",),
    "block_position_m": ("BLOCKCOMP",),
    "rig_activity_code": ("RigActivityCode",),
}

PLAUSIBLE_RANGES = {
    "hole_depth_m": (0.0, 10000.0),
    "bit_depth_m": (0.0, 10000.0),
    "rop_m_per_hr": (0.0, 500.0),
    "weight_on_bit_kn": (-50.0, 500.0),
    "surface_torque_knm": (-5.0, 100.0),
    "surface_rpm": (0.0, 350.0),
    "bit_rpm": (0.0, 400.0),
    "standpipe_pressure_bar": (0.0, 700.0),
    "flow_in_lpm": (0.0, 10000.0),
    "flow_out_lpm": (0.0, 10000.0),
    "hookload_kn": (0.0, 5000.0),
    "mud_weight_in_sg": (0.8, 3.0),
    "mud_weight_out_sg": (0.8, 3.0),
    "mud_temp_in_c": (-10.0, 150.0),
    "mud_temp_out_c": (-10.0, 150.0),
    "trip_speed_m_per_min": (0.0, 90.0),
}

ANOMALY_CHANNELS = (
    "standpipe_pressure_bar", "flow_in_lpm", "flow_out_lpm", "hookload_kn", "surface_torque_knm",
    "bit_rpm", "surface_rpm", "weight_on_bit_kn", "pit_gain_loss_m3", "bit_depth_m",
    "trip_speed_m_per_min", "mud_temp_in_c", "mud_temp_out_c",
)

BEHAVIOUR_SCALES = {
    "standpipe_pressure_bar": 50.0,
    "flow_in_lpm": 800.0,
    "hookload_kn": 300.0,
    "surface_torque_knm": 5.0,
    "bit_rpm": 30.0,
    "weight_on_bit_kn": 50.0,
}

ANALOGUE_WEIGHTS = {
    "geology": 0.30,
    "formation": 0.20,
    "depth": 0.15,
    "drilling_behaviour": 0.20,
    "geography": 0.15,
}

RISK_WEIGHTS = {"anomaly": 0.40, "historical_evidence": 0.40, "rules": 0.20}

# channel -> (min, max)
RISK_RULES = {
    "standpipe_pressure_bar": (None, 350.0),
    "pit_gain_loss_m3": (-20.0, 20.0),
    "surface_torque_knm": (None, 40.0),
    "hookload_kn": (None, 2500.0),
    "trip_speed_m_per_min": (None, 60.0),
}

RISK_LEVELS = {"INFO": 0.0, "LOW": 0.25, "MEDIUM": 0.45, "HIGH": 0.65, "CRITICAL": 0.85}

PROBLEM_TERMS = {
    "stuck pipe": "stuck_pipe",
    "stuck": "stuck_pipe",
    "pack off": "pack_off",
    "packed off": "pack_off",
    "lost circulation": "lost_circulation",
    "loss of circulation": "lost_circulation",
    "lost returns": "lost_circulation",
    "mud loss": "lost_circulation",
    "losses": "lost_circulation",
    "kick": "well_control",
    "influx": "well_control",
    "gas cut": "well_control",
    "blowout": "well_control",
    "overpull": "overpull",
    "tight hole": "tight_hole",
    "tight spot": "tight_hole",
    "excessive drag": "tight_hole",
    "hole collapse": "wellbore_instability",
    "caving": "wellbore_instability",
    "washout": "wellbore_instability",
    "twist off": "equipment_failure",
    "twistoff": "equipment_failure",
    "fishing": "fishing",
    "fish": "fishing",
    "junk": "fishing",
    "leak": "equipment_failure",
    "failure": "equipment_failure",
    "failed": "equipment_failure",
    "breakdown": "equipment_failure",
    "waiting on weather": "npt_weather",
    "wait on weather": "npt_weather",
}

ACTION_TERMS = (
    "circulated", "circulate", "increased", "reduced", "pumped", "spotted", "worked", "reamed",
    "back reamed", "jarred", "pulled out", "ran in", "displaced", "raised", "lowered", "changed",
    "replaced", "installed", "set", "cemented", "squeezed", "milled", "washed over", "sidetracked",
    "plugged",
)

NEGATION_TERMS = (
    "no", "not", "never", "none", "without", "free of", "free from", "no sign of", "no signs of",
    "no indication of", "no indications of", "no evidence of", "avoided", "prevented", "eliminated",
)
NEGATION_WINDOW_WORDS = 3

ROUTINE_TERMS = (
    "leak off", "leak-off", "leakoff", "kick drill", "kick sheet", "kick tolerance", "kick off",
    "formation integrity test", "pressure integrity test",
)

OUTCOME_TERMS = {
    "regained": "resolved",
    "restored": "resolved",
    "freed": "resolved",
    "released": "resolved",
    "successful": "resolved",
    "successfully": "resolved",
    "resumed": "resolved",
    "cured": "resolved",
    "stabilised": "resolved",
    "stabilized": "resolved",
    "controlled": "resolved",
    "unsuccessful": "not_resolved",
    "failed to": "not_resolved",
    "abandoned": "not_resolved",
    "sidetrack": "not_resolved",
}

EARTH_RADIUS_KM = 6371.0088


@dataclass(frozen=True)
class Params:
    """Thresholds that operators take as keyword arguments, gathered in one place."""

    min_rows_per_well: int = 100
    min_curve_coverage: float = 0.30
    split_fractions: dict = field(
        default_factory=lambda: {"train": 0.70, "validation": 0.15, "test": 0.15}
    )
    split_seed: int = 42
    rare_class_max_wells: int = 15
    rolling_windows_m: tuple = (5.0, 15.0)
    resample: str = "10 seconds"
    preferred_logs: tuple = ("GenTime", "GenTime2", "GwdTime", "Hydraulics")
    index_type: str = "date time"
    min_flow_lpm: float = 100.0
    min_rpm: float = 5.0
    min_trip_speed: float = 0.5
    constant_tolerance: float = 1e-9
    telemetry_windows: dict = field(default_factory=lambda: {"short": 6, "medium": 30, "long": 90})
    min_training_rows: int = 90
    trees: int = 200
    samples_per_tree: int = 256
    contamination: float = 0.02
    attribution_top: int = 5
    analogue_k: int = 5
    segment_length_m: float = 100.0
    segment_stride_m: float = 50.0
    segment_min_samples: int = 50
    depth_scale_m: float = 5000.0
    clip_sigma: float = 5.0
    radius_km: float = 50.0
    distance_decay_km: float = 25.0
    depth_tolerance_m: float = 300.0
    lookahead_m: float = 150.0
    match_tolerance_m: float = 25.0
    min_similarity: float = 0.50
    min_wells: int = 1
    supervised_threshold: int = 200
    raise_at: str = "MEDIUM"
    cooldown_s: int = 300
    alert_depth_window_m: float = 25.0
    context_step_m: float = 25.0
    lithology_tolerance_m: float = 10.0
    replay_min_speed: float = 1.0
    replay_max_speed: float = 3600.0
    min_confidence: float = 0.35
    chunk_size: int = 1200
    chunk_overlap: int = 150
    search_min_similarity: float = 0.25
    search_results: int = 10
    text_dims: int = 384
    page_limit: int = 500
    min_class_support: int = 50


DEFAULTS = Params()
