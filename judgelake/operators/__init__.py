"""Table operators: packaging, judging, compose, evaluation, sweeps, corpus."""
