"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .kmeans import OP11_SQL, op11_interval_kmeans
from .licenses import op1_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP12_SQL, op12_hash_threshold_mix
from .near_dedup import OP4_SQL, op4_bottom_k_near_dedup
from .packing import op5_linear_grouping_packing
from .quality_classifier import op6_subword_embeddings
from .quality_rules import op3_compression_bands
from .sharding import op10_sampled_splitter_shards
from .suffix_dedup import op8_anchored_suffix_dedup
from .toxicity import op7_nnpu_toxicity

QUERIES = {
    q.__name__: q
    for q in (
        op1_license_scan, op2_line_dedup, op3_compression_bands, op4_bottom_k_near_dedup, op5_linear_grouping_packing,
        op6_subword_embeddings, op7_nnpu_toxicity, op8_anchored_suffix_dedup, op9_benchmark_decontamination, op10_sampled_splitter_shards,
        op11_interval_kmeans, op12_hash_threshold_mix, op13_fill_in_middle,
    )
}
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL, "op4_bottom_k_near_dedup": OP4_SQL, "op9_benchmark_decontamination": OP9_SQL,
    "op11_interval_kmeans": OP11_SQL, "op12_hash_threshold_mix": OP12_SQL, "op13_fill_in_middle": OP13_SQL,
}
