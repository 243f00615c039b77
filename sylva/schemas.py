"""Row layouts of the sources and of the tables the operators exchange."""

from __future__ import annotations

LEXICON = "_c0 string, english string, french string, french_pretty string"
EQ = "taxon string, e_name string, e_id string, q_name string, q_id string, score double, text string"
TRAIT = "name string, name2 string, e1 string, e2 string, q string, trait string, label string"
ANNOTATION = "taxon_iri string, taxon string, class_iri string"
LABEL = "id string, label string"
TAXON_ENV = "taxon string, label string, env string"
