"""Column functions: pitch and chords, text, boxes. All are JVM-side expressions."""
