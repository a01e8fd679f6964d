"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from spindrift.llm import clustering, decontamination, divergence, mixing, packing, pii, quality_gam, quality_rules, secret_scan, sharding, simhash, toxicity, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "quality_rules_ablation": quality_rules.quality_rules_ablation,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_packing": packing.op3_packing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_gam": quality_gam.op9_quality_gam,
    "op10_pii": pii.op10_pii,
    "op11_divergence": divergence.op11_divergence,
    "op12_clustering": clustering.op12_clustering,
    "op13_mixing": mixing.op13_mixing,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "quality_rules_ablation": quality_rules.ABLATION,
    "op2_url_filters": url_filters.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op5_secret_scan": secret_scan.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op8_simhash": simhash.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_clustering": clustering.ORACLE,
}
