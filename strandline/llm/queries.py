"""Queries of the corpus operators and, where SQL can express them, the same in SQL."""

from strandline.llm.clustering import OP12_SQL, op12_clusters
from strandline.llm.decontaminate import OP9_SQL, op9_decontaminate
from strandline.llm.digests import op10_fingerprints
from strandline.llm.language import op4_language
from strandline.llm.language_model import op8_language_model
from strandline.llm.mixing import OP2_SQL, op2_mixing
from strandline.llm.packing import op13_packing
from strandline.llm.repeats import op7_repeats
from strandline.llm.resampling import OP11_SQL, op11_resampling
from strandline.llm.sharding import op3_sharding
from strandline.llm.simhash import op6_simhash
from strandline.llm.toxicity import op5_toxicity
from strandline.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_repeats": op7_repeats,
    "op8_language_model": op8_language_model,
    "op9_decontaminate": op9_decontaminate,
    "op10_fingerprints": op10_fingerprints,
    "op11_resampling": op11_resampling,
    "op12_clusters": op12_clusters,
    "op13_packing": op13_packing,
}

ORACLES = {"op1_warc": OP1_SQL, "op2_mixing": OP2_SQL, "op9_decontaminate": OP9_SQL, "op11_resampling": OP11_SQL, "op12_clusters": OP12_SQL}
