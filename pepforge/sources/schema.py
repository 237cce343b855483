"""Schemas of the files that the workflow reads."""

PSM = "experiment_name string, preds string, log_probs double"
CLUSTERS = "cluster string, contig string"
ASSEMBLY_STATS = "reference_start int, reference_end int, total_sequences int, average_length double, min_length int, max_length int, coverage double, mean_identity double, median_identity double, perfect_matches int, total_mismatches int, N50 int, N90 int"
SCORES = "category string, run string, ass_method string, source string, total_sequences int, total_sequences_scaled double, max_length int, max_length_scaled double, N50 int, N50_scaled double, coverage double, coverage_scaled double, composite_score double"
METADATA = "map<string, array<struct<protein:string, chain:string, proteases:array<string>>>>"
GRID = "map<string, map<string, array<double>>>"
COLORS = "map<string, map<string, string>>"
