"""fieldledger: cleaning, assembling and auditing ordered, hand-transcribed records on Spark."""
