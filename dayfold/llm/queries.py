"""The registered queries of the operators and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from dayfold.llm.automata import OP5_ORACLE, op5_automaton_dedup
from dayfold.llm.best_fit import op13_best_fit
from dayfold.llm.byte_bpe import op9_byte_bpe
from dayfold.llm.collocations import OP12_ORACLE, op12_collocations
from dayfold.llm.hosts import op6_url_trust
from dayfold.llm.packing import op4_packing
from dayfold.llm.pseudo_likelihood import op8_pseudo_likelihood
from dayfold.llm.quality import op10_quality_forest
from dayfold.llm.simhash import op1_simhash
from dayfold.llm.suffixes import OP3_ORACLE, op3_suffix_dedup
from dayfold.llm.syncmers import op2_syncmers
from dayfold.llm.toxicity import op7_toxicity
from dayfold.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_syncmers, op3_suffix_dedup, op4_packing, op5_automaton_dedup, op6_url_trust, op7_toxicity, op8_pseudo_likelihood, op9_byte_bpe, op10_quality_forest,
    op11_whitening, op12_collocations, op13_best_fit,
)}

ORACLES: dict[str, str] = {"op3_suffix_dedup": OP3_ORACLE, "op5_automaton_dedup": OP5_ORACLE, "op12_collocations": OP12_ORACLE}
