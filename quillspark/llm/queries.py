"""The queries of this folder, one for each operator, and SQL where it can express one."""

from __future__ import annotations

from quillspark.llm.ann import op6_nearest_neighbours
from quillspark.llm.importance import OP13_SQL, op13_importance_resampling
from quillspark.llm.licenses import OP12_SQL, op12_license_scan
from quillspark.llm.lm_scores import op7_lm_scores
from quillspark.llm.mixing import OP1_SQL, op1_source_mixing
from quillspark.llm.near_dups import op9_ngram_jaccard_join
from quillspark.llm.quality import op3_quality
from quillspark.llm.secrets import op4_secret_scan
from quillspark.llm.sentencepieces import op10_sentencepiece
from quillspark.llm.sketches import op8_document_fingerprints
from quillspark.llm.token_files import op5_token_binary
from quillspark.llm.toxicity import op2_toxicity
from quillspark.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_toxicity, op3_quality, op4_secret_scan, op5_token_binary, op6_nearest_neighbours, op7_lm_scores, op8_document_fingerprints, op9_ngram_jaccard_join, op10_sentencepiece, op11_embedding_whitening, op12_license_scan, op13_importance_resampling)}
SQL = {"op1_source_mixing": OP1_SQL, "op12_license_scan": OP12_SQL, "op13_importance_resampling": OP13_SQL}
