"""The benchmark's task dimension: roles, lengths and groups, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TASK_SIGNALS, TASKS

# Signals of which single missing channels may be filled.
FILLED = [
    "magnetics-flux_loop_flux",
    "magnetics-b_field_pol_probe_ccbv_field",
    "magnetics-b_field_pol_probe_obr_field",
    "magnetics-b_field_pol_probe_obv_field",
    "magnetics-b_field_tor_probe_saddle_voltage",
    "thomson_scattering-t_e",
    "thomson_scattering-n_e",
]

# Signals that share a chain of transforms.
LCFS = ["equilibrium-lcfs_r", "equilibrium-lcfs_z"]
X_POINTS = ["equilibrium-x_point_r", "equilibrium-x_point_z"]
PROBES = ["magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"]

# Inputs, actuators and outputs of each task.
ROLES = {
    "1-1": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        [],
        ["equilibrium-elongation", "equilibrium-elongation_axis", "equilibrium-triangularity_upper", "equilibrium-triangularity_lower", "equilibrium-x_point_r", "equilibrium-x_point_z", "equilibrium-minor_radius", "equilibrium-magnetic_axis_r", "equilibrium-magnetic_axis_z", "equilibrium-q95", "equilibrium-beta_tor", "equilibrium-beta_pol", "equilibrium-beta_normal", "equilibrium-bvac_rmag", "equilibrium-bphi_rmag"],
    ),
    "1-2": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        [],
        ["equilibrium-lcfs_r", "equilibrium-lcfs_z"],
    ),
    "1-3": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        [],
        ["equilibrium-psi"],
    ),
    "2-1": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        ["pf_active-coil_voltage", "summary-power_nbi"],
        ["pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "equilibrium-elongation", "equilibrium-elongation_axis", "equilibrium-triangularity_upper", "equilibrium-triangularity_lower", "equilibrium-x_point_r", "equilibrium-x_point_z", "equilibrium-minor_radius", "equilibrium-magnetic_axis_r", "equilibrium-magnetic_axis_z", "equilibrium-q95", "equilibrium-beta_tor", "equilibrium-beta_pol", "equilibrium-beta_normal", "equilibrium-bvac_rmag", "equilibrium-bphi_rmag"],
    ),
    "2-2": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        ["pf_active-coil_voltage", "summary-power_nbi"],
        ["equilibrium-lcfs_r", "equilibrium-lcfs_z"],
    ),
    "2-3": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip"],
        ["pf_active-coil_voltage", "summary-power_nbi"],
        ["equilibrium-psi"],
    ),
    "3-1": (
        ["thomson_scattering-t_e", "thomson_scattering-n_e"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["thomson_scattering-t_e", "thomson_scattering-n_e"],
    ),
    "3-2": (
        ["thomson_scattering-t_e", "thomson_scattering-n_e", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"],
    ),
    "3-3": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["thomson_scattering-t_e", "thomson_scattering-n_e", "equilibrium-beta_tor", "equilibrium-beta_pol", "equilibrium-beta_normal"],
    ),
    "4-1": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"],
    ),
    "4-2": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage", "thomson_scattering-t_e", "thomson_scattering-n_e"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"],
    ),
    "4-3": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["equilibrium-magnetic_axis_z"],
    ),
    "4-4": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["summary-ip"],
    ),
    "4-5": (
        ["magnetics-flux_loop_flux", "magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_tor_probe_saddle_voltage", "pf_active-coil_current", "pf_active-solenoid_current", "summary-ip", "interferometer-n_e_line", "spectrometer_visible-filter_spectrometer_dalpha_voltage", "soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"],
        ["pulse_schedule-i_plasma", "pulse_schedule-n_e_line", "summary-power_nbi", "gas_injection-total_injected"],
        ["magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_pol_probe_omv_voltage"],
    ),
}

# Signals that an expert's flag on a shot makes unusable.
FLAGS = {
    "thomson_max_outlier": ["thomson_scattering-n_e", "thomson_scattering-t_e"],
    "thomson_nan_count_outlier": ["thomson_scattering-n_e", "thomson_scattering-t_e"],
    "sxr_max_outlier": ["soft_x_rays-horizontal_cam_lower", "soft_x_rays-horizontal_cam_upper"],
    "magnetics_bfield_probe_mean_outlier": ["magnetics-b_field_pol_probe_ccbv_field", "magnetics-b_field_pol_probe_obr_field", "magnetics-b_field_pol_probe_obv_field", "magnetics-b_field_pol_probe_omv_voltage", "magnetics-b_field_tor_probe_cc_field", "magnetics-b_field_tor_probe_saddle_voltage"],
}

# Fixed values: (task, type, input, output, delta) in seconds; the first digit is the group.
LENGTHS = [
    ("1-1", "markovian", 0.005, 0.005, -0.005), ("1-2", "markovian", 0.005, 0.005, -0.005), ("1-3", "markovian", 0.005, 0.005, -0.005),
    ("2-1", "markovian", 0.005, 0.025, 0.0), ("2-2", "markovian", 0.005, 0.025, 0.0), ("2-3", "markovian", 0.005, 0.025, 0.0),
    ("3-1", "markovian", 0.005, 0.050, 0.0), ("3-2", "markovian", 0.005, 0.050, 0.0), ("3-3", "non_markovian", 0.150, 0.005, 0.0),
    ("4-1", "non_markovian", 0.150, 0.100, 0.0), ("4-2", "non_markovian", 0.150, 0.100, 0.0), ("4-3", "non_markovian", 0.150, 0.100, 0.0),
    ("4-4", "non_markovian", 0.150, 0.100, 0.0), ("4-5", "non_markovian", 0.150, 0.100, 0.0),
]
STRIDE = 0.001


def task_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, int(t[0]), kind, i, o, d, STRIDE) for t, kind, i, o, d in LENGTHS], TASKS)


def task_signal_table(spark: SparkSession, roles: dict[str, tuple[list[str], list[str], list[str]]] = ROLES) -> DataFrame:
    """(task, role, pos, signal)"""
    return spark.createDataFrame([(t, role, k, s) for t, of in roles.items() for role, signals in zip(("input", "actuator", "output"), of, strict=True) for k, s in enumerate(signals)], TASK_SIGNALS)


def task_parameters(name: str) -> dict:
    """One task as parameters of the window operators."""
    kind, i, o, d = next(x[1:] for x in LENGTHS if x[0] == name)
    roles = [(role, s) for role, signals in zip(("input", "actuator", "output"), ROLES[name], strict=True) for s in signals]
    return {"task_type": kind, "input_length": i, "output_length": o, "delta": d, "stride": STRIDE, "roles": roles}


def task_from_mapping(mapping: dict) -> dict:
    """A task's parameters from its configuration; roles become (role, signal) pairs."""
    lengths = {k: float(mapping[k]) for k in ("input_length", "output_length", "delta", "stride")}
    if mapping.get("task_type") not in ("markovian", "non_markovian"):
        raise ValueError(f"unknown task type {mapping.get('task_type')}")
    roles = [(role, s) for role in ("input", "actuator", "output") for s in mapping.get(role) or []]
    return lengths | {"task_type": mapping["task_type"], "roles": roles}
