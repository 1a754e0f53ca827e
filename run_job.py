"""spark-submit driver script: ``spark-submit --py-files lurescope.zip run_job.py batch|stream ...``."""
from lurescope.plans.jobs import main

if __name__ == "__main__":
    main()
