"""DataFrame-to-DataFrame operators: profile, split and audit."""
