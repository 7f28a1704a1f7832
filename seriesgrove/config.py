"""Settings by name, from keywords or from a command line of --name=value.

Some settings exist for compatibility only and have no effect on Spark, which
schedules tasks and memory itself; COMPATIBLE_ONLY lists them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from seriesgrove.functions.models import Training
from seriesgrove.operators.tree import TreeSettings


@dataclass
class Config:
    # Names and defaults are fixed: users pass them.
    # Input and output
    log_filepath: str = "./search.log"
    log_filepath_qyl: str = "./search_report.log"
    results_path: str = "./results/"
    db_filepath: str = ""
    query_filepath: str = ""
    is_sketch_provided: bool = False
    sketch_length: int = -1
    train_sketch_filepath: str = ""
    query_sketch_filepath: str = ""
    series_length: int = -1
    is_znormalized: bool = False
    db_size: int = -1
    query_size: int = -1
    batch_load_size: int = -1
    default_nbuffer: int = 65536
    on_disk: bool = False
    index_dump_folderpath: str = "."
    dump_index: bool = False
    load_index: bool = False
    load_filters: bool = False
    index_load_folderpath: str = ""
    index_load_node_info_folderpath: str = ""
    index_load_filters_folderpath: str = ""
    index_load_data_folderpath: str = ""
    # Index
    leaf_size: int = 100
    node_nchildren: int = 2
    vsplit_nsubsegment: int = 2
    vsplit_gain_factor: float = 2
    # Search
    exact_search: bool = False
    search_max_nseries: int = -1
    search_max_nnode: int = -1
    n_nearest_neighbor: int = 10
    ground_truth: bool = False
    to_profile_search: bool = False
    to_profile_search_exhausting: bool = False
    to_profile_filters: bool = False
    # Navigator
    navigator_is_learned: bool = False
    navigator_train_k_nearest_neighbor: int = 5
    navigator_is_combined: bool = False
    navigator_combined_lambda: float = 0.2
    navigator_is_gpu: bool = False
    navigator_train_val_split: float = 0.9
    # Calibration
    filter_conformal_num_batches: int = 1
    filter_valid_ratio: float = 0.6
    filter_conformal_n_parts: int = 10
    filter_conformal_k_parts: int = 3
    filter_conformal_use_combinatorial: bool = False
    filter_is_conformal: bool = False
    filter_conformal_core_type: str = "discrete"
    filter_conformal_confidence: float = -1
    filter_conformal_recall: float = -1
    filter_conformal_gamma: float = 0.1
    filter_conformal_coverage: float = 0.9
    filter_conformal_is_smoothened: bool = False
    filter_conformal_smoothen_method: str = "spline"
    filter_conformal_smoothen_core: str = "steffen"
    # Allocation
    filter_max_gpu_memory_mb: float = 1e6
    filter_model_setting: str = ""
    filter_candidate_settings_filepath: str = ""
    filter_allocate_is_gain: bool = False
    filter_node_size_threshold: int = 0
    filter_trial_confidence_level: float = 0.95
    filter_trial_iterations: int = 20000
    filter_default_node_size_threshold: int = 8
    filter_trial_nnode: int = 32
    allocator_cpu_trial_iterations: int = 10000
    filter_retrain_: bool = False
    filter_reallocate_single: bool = False
    filter_reallocate_multi: bool = False
    filter_fixed_node_size_threshold: int = -1
    # Training data
    filter_train_nexample: int = -1
    filter_query_filepath: str = ""
    filter_collect_mthread: bool = False
    filter_collect_nthread: int = -1
    filter_query_noise_level: float = 0.1
    filter_num_synthetic_query_per_filter: int = -1
    filter_train_num_global_example: int = -1
    filter_train_num_local_example: int = -1
    filter_query_min_noise: float = 0.1
    filter_query_max_noise: float = 0.4
    # Model and training
    require_neurofilter: bool = False
    dim_latent: int = -1
    dropout_p: float = 0.5
    leaky_relu_negative_slope: float = 0.1
    filter_train_is_gpu: bool = False
    filter_infer_is_gpu: bool = False
    device_id: int = 0
    filter_train_batchsize: int = -1
    filter_train_nepoch: int = 100
    learning_rate: float = 0.01
    filter_train_min_lr: float = 0.0001
    filter_train_clip_grad: bool = False
    clip_grad_norm_type: float = 2
    clip_grad_max_norm: float = 1
    filter_train_mthread: bool = False
    filter_train_nthread: int = 4
    filter_remove_square: bool = False
    filter_train_val_split: float = 0.9
    filter_cnn_num_channel: int = -1
    filter_cnn_kernel_size: int = -1
    filter_lr_factor: float = 0.1
    filter_rnn_hidden_dim: int = 64

    def __post_init__(self) -> None:
        if self.search_max_nnode > 0 or self.search_max_nseries > 0:
            self.exact_search = True  # a budget is one of the exact search
        if self.filter_conformal_confidence < 0:
            self.filter_conformal_confidence = 0.95
        if self.filter_query_min_noise > self.filter_query_max_noise:
            self.filter_query_min_noise, self.filter_query_max_noise = self.filter_query_max_noise, self.filter_query_min_noise
        if self.dim_latent <= 0:
            self.dim_latent = max(self.series_length, 0)

    def check(self) -> list[str]:
        """What does not fit together."""
        wrong = []
        for held, text in (
            (self.series_length <= 0, "series_length is required"),
            (self.vsplit_nsubsegment != 2, "a segment splits into two"),
            (self.is_sketch_provided and self.sketch_length <= 0, "a sketch needs its length"),
            (self.require_neurofilter and self.navigator_is_learned, "filters and navigator exclude each other"),
            (self.filter_allocate_is_gain and self.filter_fixed_node_size_threshold > 0, "allocation by gain has no fixed size"),
            ((self.filter_retrain_ or self.filter_reallocate_single or self.filter_reallocate_multi) and not (self.load_index and self.load_filters), "retraining needs a loaded index and filters"),
            (self.load_index and self.dump_index and self.index_load_folderpath == self.index_dump_folderpath, "an index cannot be written where it is read"),
            (self.require_neurofilter and not self.load_filters and not (self.filter_query_filepath or self.filter_train_nexample > 0 or self.filter_train_num_global_example > 0), "filters need training queries"),
            (self.filter_conformal_recall > 1 or self.filter_conformal_coverage > 1, "recall and coverage are shares"),
        ):
            if held:
                wrong.append(text)
        return wrong

    def tree(self) -> TreeSettings:
        return TreeSettings(leaf_size=self.leaf_size, children=self.node_nchildren, vertical_factor=self.vsplit_gain_factor)

    def training(self) -> Training:
        return Training(
            epochs=self.filter_train_nepoch, rate=self.learning_rate, batch=max(0, self.filter_train_batchsize), share=self.filter_train_val_split, slope=self.leaky_relu_negative_slope,
            clip=self.clip_grad_max_norm if self.filter_train_clip_grad else 0.0, factor=self.filter_lr_factor, channels=self.filter_cnn_num_channel if self.filter_cnn_num_channel > 0 else 8,
            kernel=self.filter_cnn_kernel_size if self.filter_cnn_kernel_size > 0 else 5, hidden=self.filter_rnn_hidden_dim, least_rate=self.filter_train_min_lr, remove_square=self.filter_remove_square,
        )

    @staticmethod
    def parse(arguments: list[str]) -> Config:
        """From --name=value or --name value; a flag alone is true."""
        kinds = {f.name: f.type for f in fields(Config)}
        found: dict[str, object] = {}
        i = 0
        while i < len(arguments):
            name, equals, value = arguments[i].removeprefix("--").partition("=")
            if name not in kinds:
                raise ValueError(f"no setting named {name!r}")
            i += 1
            if not equals:
                if kinds[name] == "bool" and (i == len(arguments) or arguments[i].startswith("--")):
                    value = "true"
                elif i < len(arguments):
                    value, i = arguments[i], i + 1
                else:
                    raise ValueError(f"{name} needs a value")
            found[name] = value.lower() in ("1", "true", "yes", "on") if kinds[name] == "bool" else {"int": int, "float": float, "str": str}[kinds[name]](value)
        return Config(**found)


#: Accepted, without effect here: Spark reads, schedules and logs by itself, and predictions are made on CPUs.
COMPATIBLE_ONLY = (
    "is_znormalized", "batch_load_size", "default_nbuffer", "on_disk", "filter_train_is_gpu", "filter_infer_is_gpu", "device_id", "navigator_is_gpu", "filter_collect_mthread", "filter_collect_nthread",
    "filter_train_mthread", "filter_train_nthread", "filter_valid_ratio", "filter_conformal_gamma", "filter_query_noise_level", "dropout_p", "clip_grad_norm_type", "navigator_train_val_split",
    "to_profile_search", "to_profile_search_exhausting", "to_profile_filters", "log_filepath", "log_filepath_qyl", "index_load_node_info_folderpath", "index_load_filters_folderpath", "index_load_data_folderpath",
    "allocator_cpu_trial_iterations", "filter_trial_iterations", "filter_conformal_smoothen_method",
)
