"""Column expressions.  All are JVM-side except the Arrow UDFs in ``bodies`` and ``html``."""
