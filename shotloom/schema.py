"""Table schemas of the library, as DDL strings, and the names of its metrics."""

SIGNAL_META = "signal string, dt double, values_shape array<int>, mean double, std double"
TASKS = "task string, group_id int, task_type string, input_length double, output_length double, delta double, stride double"
TASK_SIGNALS = "task string, role string, pos int, signal string"
WINDOW_METRICS = "shot_id long, window_index int, feature_name string, RMSE double, MAE double, nan_fraction double, task string"
METRICS = ["NRMSE", "NMAE", "RMSE", "MAE", "nan_fraction"]
