"""Query plans: the wiring of sources and operators, the parameterised views
and the catalogue of registered queries."""
