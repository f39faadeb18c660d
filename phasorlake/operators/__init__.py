"""Signal preparation, clustering, mixtures, hidden Markov models and evaluation."""
