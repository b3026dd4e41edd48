"""Training-data operators: PII, decontamination, line and document dedup, HTML
extraction, language-model and quality scoring, nearest neighbours, secrets and
SentencePiece coding.  Nothing outside this subpackage imports it."""
