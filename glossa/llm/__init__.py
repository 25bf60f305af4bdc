"""Training-data operators (language ID, licences, fingerprints, BPE, ANN, quality, packing, near duplicates, PII,
toxicity). One module per operator; ``queries`` registers one ``opN_<name>`` query for each. Nothing else in the
library imports this subpackage."""
