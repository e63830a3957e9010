"""Where messages and tables come from; the only modules, with sinks and jobs, that know."""
