"""Constants that are part of the analysis semantics."""

SAMPLE_RATE = 22050
N_FFT = 2048
HOP = 512
ROLLOFF = 0.85
N_MFCC = 20
# Edges of the energy bands in Hz, and the bands' names.
BAND_EDGES = (20.0, 60.0, 150.0, 400.0, 1000.0, 2500.0, 5000.0, 8000.0, 11000.0)
BAND_NAMES = ("sub", "bass", "low_mid", "mid", "high_mid", "presence", "brilliance", "air")
SMOOTH_WINDOW = 3
TOP_DB = 80.0
TEMPO_RANGE = (70.0, 180.0)
CONFIDENCE_BPM = (40.0, 240.0)
BEATS_PER_BAR = 4
# Key profiles of Krumhansl and Kessler (1982), from the tonic upwards.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
STRUCTURE_FPS = 5.0
MAX_SECTIONS = 8
MIN_SECTION_SEC = 2.0
DROP_ENERGY = 0.88
SILENCE_LUFS = -70.0
SILENCE_PEAK = -80.0
QUICK_HASH_BYTES = 1 << 20
AUDIO_EXTENSIONS = (".mp3", ".flac", ".wav", ".m4a", ".ogg")
TEMPO_TOLERANCE = 0.06
TEMPO_TOLERANCE_RELAXED = 0.10
MIN_BPM_CONFIDENCE = 0.5
MIN_KEY_CONFIDENCE = 0.4
SCORE_WEIGHTS = {"timbre": 0.45, "band": 0.20, "harmonic": 0.15, "tempo": 0.10, "energy": 0.10}
TARGET_LUFS = -14.0
CEILING_DBTP = -1.0
CROSSOVER_HZ = 150.0
LIGHT_FPS = 60
GAMMA = 2.2
