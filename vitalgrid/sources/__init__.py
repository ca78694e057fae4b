"""Sources, sinks, data-quality gates and the adapters that map the driver
tables onto panel schemas."""
