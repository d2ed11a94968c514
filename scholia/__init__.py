"""Literature analytics and ranked retrieval as Catalyst plans."""
