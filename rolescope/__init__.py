"""Job-advert analytics as DataFrame operators.

``functions``  Column -> Column expressions and the rule sets they use
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers
``plans``      the composed jobs: cohort, discovery, quality, cleaning, skills, geography, sharing
``streaming``  the incremental form of the CSV load
"""
