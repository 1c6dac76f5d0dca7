"""Training-data operators: token counts, mixing, deduplication, scoring, extraction, decontamination.

Nothing outside this folder imports it; its queries are collected in ``keyloom.llm.queries``.
"""
