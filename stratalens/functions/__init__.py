"""Part of the engine; see the package README section."""
