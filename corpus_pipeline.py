"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing of sources, BPE; see loomgraph/llm/stages.py."""

from loomgraph.llm.stages import ORACLE_SQL, STAGES, bpe, line_dedup, mixing, near_dedup, run, toxicity

__all__ = ["ORACLE_SQL", "STAGES", "bpe", "line_dedup", "mixing", "near_dedup", "run", "toxicity"]
