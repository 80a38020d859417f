"""Defaults of retrieval, chunking and review."""

TOP_K = 20
MMR_K, MMR_LAMBDA = 10, 0.6
SCORE_FLOOR = 0.25
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_MIN_CHARS = 512, 80, 100
CONTEXT_CHARS, PASSAGE_CHARS = 18_000, 2_500
BATCH_CHARS, MAX_BATCHES = 6_000, 3
SECTION_LONG, HEADING_SHORT, SECTION_SHORT, DOCUMENT_LEAST = 1_500, 80, 150, 40
PASSAGE_PACK, PASSAGES_CHOSEN = 700, 9
SUMMARY_CHARS = 2_000
TEXT_FILE_MOST = 5 * 1024 * 1024
DOCX_XML_MOST, PDF_PAGES_MOST, PDF_BLOCK_LEAST = 20 * 1024 * 1024, 200, 20
#: Below this length a vector counts as zero (the epsilon of 32-bit floats).
ZERO_NORM = 1.1920929e-07
EMBED_DIM = 384
