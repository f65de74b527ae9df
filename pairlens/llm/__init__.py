"""Training-data operators: packing, scanning, formatting, decontamination and classification.

Each module holds one operator with its own interface; :mod:`pairlens.llm.queries`
registers the thin ``opN_<name>`` queries over the test tables.  Nothing outside this
subpackage imports it.
"""
